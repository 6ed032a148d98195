"""Jobs for product events, in batch and as drained streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmart.operators import events as E
from helixmart.plans.check_views import rnd
from helixmart.plans.jobs_features import rounded
from helixmart.plans.registry import CHECK_VIEWS, job
from helixmart.session import scratch_dir
from helixmart.sources import record_log
from helixmart.sources.adapters import ADAPTERS
from helixmart.streaming import jobs as stream

V = CHECK_VIEWS
V["flat_events"] = """
SELECT c->>'event_id' AS event_id, c->>'user_id' AS user_id, c->>'session_id' AS session_id, c->>'event_type' AS event_type,
 c->>'button_name' AS button_name, c->>'status' AS status, c->>'user_type' AS user_type, c->>'source' AS source,
 CAST(replace(replace(c->>'timestamp', 'T', ' '), 'Z', '') AS TIMESTAMP) AS app_timestamp,
 make_timestamp(CAST(m->>'CreateTime' AS BIGINT) * 1000) AS kafka_ingest_timestamp
FROM (SELECT CAST(record_content AS JSON) AS c, CAST(record_metadata AS JSON) AS m FROM event_records)"""


def flat(w):
    return E.flatten(w["event_records"])


job("l1_flat_events", "SELECT * FROM flat_events")(flat)
job("a11_event_json", """
SELECT event_id, json_object('event_id', CAST(event_id AS VARCHAR), 'event_type', event_type, 'timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'),
 'user_type', 'user', 'user_id', CASE WHEN event_id % 12 = 0 THEN 'anonymous' ELSE CAST(user_id AS VARCHAR) END, 'session_id',
 CASE WHEN event_id % 10 = 0 THEN 'unknown' ELSE 's' || user_id END, 'button_name', 'find_centers', 'status', 'success',
 'source', 'web_app')::VARCHAR AS value FROM events""")(
    lambda w: E.to_event_json(w["events"].select(
        "event_id", "event_type", "ts", F.when(F.col("event_id") % 12 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("session_id"),
        F.lit("find_centers").alias("button_name"), F.lit("success").alias("status"))))
job("d29_feature_usage", "SELECT event_type, button_name, status, count(*) AS n FROM flat_events GROUP BY ALL")(
    lambda w: E.usage(flat(w)))
job("d29_daily_trend", """
SELECT CAST(app_timestamp AS DATE) AS day, count(*) AS n, count(*) FILTER (status = 'success') AS n_success,
 count(*) FILTER (status = 'failure') AS n_failure FROM flat_events GROUP BY 1""")(lambda w: E.daily_trend(flat(w)))
V["hourly"] = """
SELECT date_trunc('hour', app_timestamp) AS window_start, date_trunc('hour', app_timestamp) + INTERVAL 1 HOUR AS window_end,
 event_type, status, count(*) AS n FROM flat_events GROUP BY ALL"""
job("l3_window_usage", "SELECT * FROM hourly")(lambda w: E.window_usage(flat(w)))
job("l4_sessions", """
SELECT session_id, min(app_timestamp) AS started_at, max(app_timestamp) AS ended_at, count(*) AS n_events FROM flat_events GROUP BY session_id""")(
    lambda w: E.sessions(flat(w)))
_GAP_SESSIONS = """
SELECT visitor, session_no, min(app_timestamp) AS started_at, max(app_timestamp) AS ended_at, count(*) AS n_events
FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY visitor ORDER BY app_timestamp, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no
 FROM (SELECT *, CASE WHEN app_timestamp - lag(app_timestamp) OVER (PARTITION BY visitor ORDER BY app_timestamp, event_id) <= INTERVAL 30 MINUTE
  THEN 0 ELSE 1 END AS fresh FROM (SELECT *, CASE WHEN user_id <> 'anonymous' THEN user_id
   WHEN session_id <> 'unknown' THEN 'session ' || session_id ELSE 'anonymous' END AS visitor FROM flat_events))) GROUP BY visitor, session_no"""
job("l4_gap_sessions", _GAP_SESSIONS)(lambda w: E.gap_sessions(flat(w)))
job("l4_retention", """
SELECT cohort_week, CAST((week - cohort_week) // 7 AS INT) AS week_offset, count(*) AS n_users
FROM (SELECT DISTINCT user_id, CAST(date_trunc('week', app_timestamp) AS DATE) AS week, CAST(min(date_trunc('week', app_timestamp))
 OVER (PARTITION BY user_id) AS DATE) AS cohort_week FROM flat_events WHERE user_id <> 'anonymous') GROUP BY ALL""")(
    lambda w: E.retention(flat(w)))
_LAG = "epoch_us(kafka_ingest_timestamp) / 1e6::DOUBLE - epoch_us(app_timestamp) / 1e6::DOUBLE"
_LAG_DIGITS = {"min_lag": 6, "max_lag": 6, "avg_lag": 4, "p50": 6, "p95": 4}
job("l5_event_lag", f"""
SELECT event_type, {rnd("min(v)", 6)} AS min_lag, {rnd("max(v)", 6)} AS max_lag, {rnd("avg(v)", 4)} AS avg_lag,
 {rnd("quantile_cont(v, 0.5)", 6)} AS p50, {rnd("quantile_cont(v, 0.95)", 4)} AS p95
FROM (SELECT event_type, (epoch_us(kafka_ingest_timestamp) - epoch_us(app_timestamp)) / 1e6::DOUBLE AS v FROM flat_events) GROUP BY event_type""")(
    lambda w: rounded(E.lag_by_type(flat(w)), _LAG_DIGITS))


def record_stream(w):
    """The events table as a file stream of landing records."""
    path = f"{w.folder}/events.parquet"
    schema = w.spark.read.parquet(path).schema
    # as a pattern, since a stream source takes a folder or a pattern but no single file
    w.spark.readStream.schema(schema).parquet(f"{path}*").createOrReplaceTempView("events")
    return w.spark.sql(ADAPTERS["event_records"])


job("l2_stream_landing", "SELECT event_id, event_type, app_timestamp FROM flat_events")(
    lambda w: stream.drain(E.flatten(record_stream(w)), scratch_dir(w.spark, "landing"))
    .select("event_id", "event_type", "app_timestamp"))
job("l3_stream_usage", """
SELECT * FROM hourly WHERE window_end <= (SELECT max(app_timestamp) - INTERVAL 1 HOUR FROM flat_events)""")(
    lambda w: stream.drain(stream.live_usage(record_stream(w)), scratch_dir(w.spark, "usage")))
job("l3_stream_usage_open", "SELECT * FROM hourly")(
    lambda w: stream.drain_updates(stream.live_usage(record_stream(w)), scratch_dir(w.spark, "usage"), ["window_start", "window_end", "event_type", "status"]))


def ended_records(w, folder: str):
    """The landed records as files of a stream, the last of which moves the watermark past all of them."""
    records = w["event_records"]
    records.write.parquet(folder)
    end = E.flatten(records).agg(F.date_format(F.max("app_timestamp") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"))
    last = end.select(F.lit("{}").alias("record_metadata"), F.concat(
        F.lit('{"event_id":"end of stream","user_id":"end of stream","timestamp":"'), "t", F.lit('"}')).alias("record_content"))
    last.write.mode("append").parquet(folder)
    return stream.file_records(w.spark, folder)


def _live_gap_sessions(w):
    folder = scratch_dir(w.spark, "silence")
    return stream.with_state_store(w.spark, lambda: stream.drain(stream.live_gap_sessions(ended_records(w, f"{folder}/in")), folder))


job("l4_stream_gap_sessions", _GAP_SESSIONS)(_live_gap_sessions)


def _log_stream(w):
    folder = scratch_dir(w.spark, "record-log")
    record_log.append_log(w["event_records"], f"{folder}/log")
    return stream.drain(E.flatten(record_log.log_records(w.spark, f"{folder}/log")), folder).select("event_id", "event_type", "app_timestamp", "kafka_ingest_timestamp")


job("a10_record_log_stream", "SELECT event_id, event_type, app_timestamp, kafka_ingest_timestamp FROM flat_events")(_log_stream)
