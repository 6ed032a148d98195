"""Product events: flattening, usage, sessions, retention and lag. Batch and stream share these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from helixmart.operators.ranking import group_quantiles

FIELDS = ["event_id", "user_id", "session_id", "event_type", "button_name", "status", "user_type", "source"]
SESSION_GAP_SECONDS = 1800


def to_event_json(events: DataFrame, source: str = "web_app") -> DataFrame:
    """The JSON text a producer sends: UTC time with Z, anonymous and unknown for missing ids."""
    body = F.struct(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_type"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.lit("user").alias("user_type"),
        F.coalesce(F.col("user_id").cast("string"), F.lit("anonymous")).alias("user_id"),
        F.coalesce(F.col("session_id").cast("string"), F.lit("unknown")).alias("session_id"),
        F.col("button_name"), F.col("status"), F.lit(source).alias("source"))
    return events.select("event_id", F.to_json(body).alias("value"))


def _variant(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return column if isinstance(df.schema[name].dataType, T.VariantType) else F.try_parse_json(column)


def flatten(records: DataFrame) -> DataFrame:
    """Two semi-structured columns to ten typed ones; absent fields become NULL."""
    parsed = records.select(_variant(records, "record_content").alias("_c"), _variant(records, "record_metadata").alias("_m"))
    return parsed.select(
        *[F.try_variant_get("_c", f"$.{name}", "string").alias(name) for name in FIELDS],
        F.try_variant_get("_c", "$.timestamp", "string").try_cast("timestamp").alias("app_timestamp"),
        F.timestamp_millis(F.try_variant_get("_m", "$.CreateTime", "bigint")).alias("kafka_ingest_timestamp"))


def usage(flat: DataFrame) -> DataFrame:
    return flat.groupBy("event_type", "button_name", "status").agg(F.count("*").alias("n"))


def daily_trend(flat: DataFrame) -> DataFrame:
    return flat.groupBy(F.to_date("app_timestamp").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("n_success"),
        F.count_if(F.col("status") == "failure").alias("n_failure"))


def window_usage(flat: DataFrame, width: str = "1 hour") -> DataFrame:
    """Tumbling counts per event type and status."""
    return flat.groupBy(F.window("app_timestamp", width).alias("w"), "event_type", "status").agg(
        F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "status", "n")


def sessions(flat: DataFrame) -> DataFrame:
    """Span and size per session id; rows without one are left to ``gap_sessions``."""
    known = flat.where(F.col("session_id").isNotNull() & (F.col("session_id") != "unknown"))
    return known.groupBy("session_id").agg(
        F.min("app_timestamp").alias("started_at"), F.max("app_timestamp").alias("ended_at"),
        F.count("*").alias("n_events"))


def visitor() -> Column:
    """Who an event belongs to: the user, else the session; events without both share one visitor, ``anonymous``."""
    user = F.when(F.col("user_id") != "anonymous", F.col("user_id"))
    session = F.when(F.col("session_id") != "unknown", F.concat(F.lit("session "), "session_id"))
    return F.coalesce(user, session, F.lit("anonymous"))


def gap_sessions(flat: DataFrame, user: str = "visitor", gap: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Sessions per visitor split by more than ``gap`` seconds of silence.

    Events are first reduced to one row per user and gap-long slot: inside a slot no
    silence can exceed the gap. The window then sees at most one row per slot, so a
    user with a third of all events stays small.
    """
    seconds = F.unix_micros("app_timestamp") / 1e6
    if user == "visitor":
        flat = flat.withColumn(user, visitor())
    slots = flat.where(F.col("app_timestamp").isNotNull() & F.col(user).isNotNull()).groupBy(
        user, F.floor(seconds / gap).alias("_slot")
    ).agg(F.min("app_timestamp").alias("_first"), F.max("app_timestamp").alias("_last"), F.count("*").alias("_n"))
    in_order = W.partitionBy(user).orderBy("_slot")
    silence = (F.unix_micros("_first") - F.lag(F.unix_micros("_last")).over(in_order)) / 1e6
    numbered = slots.withColumn("_new", F.when(silence > gap, 1).when(silence.isNull(), 1).otherwise(0)).withColumn(
        "session_no", F.sum("_new").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(user, "session_no").agg(
        F.min("_first").alias("started_at"), F.max("_last").alias("ended_at"), F.sum("_n").alias("n_events"))


def retention(flat: DataFrame) -> DataFrame:
    """Users of each first week still active k weeks later."""
    known = flat.where(F.col("user_id").isNotNull() & (F.col("user_id") != "anonymous"))
    active = known.select("user_id", F.to_date(F.date_trunc("week", "app_timestamp")).alias("week")).distinct()
    first = active.groupBy("user_id").agg(F.min("week").alias("cohort_week"))
    offset = F.floor(F.datediff("week", "cohort_week") / 7).cast("int")
    return active.join(first, "user_id").groupBy("cohort_week", offset.alias("week_offset")).agg(
        F.count("*").alias("n_users"))


def lag_seconds() -> Column:
    return (F.unix_micros("kafka_ingest_timestamp") - F.unix_micros("app_timestamp")) / 1e6


def lag_by_type(flat: DataFrame) -> DataFrame:
    """Ingest minus app time per event type; quantiles are exact at any group size."""
    timed = flat.withColumn("lag", lag_seconds())
    middle = group_quantiles(timed, ["event_type"], "lag", {"p50": 0.5, "p95": 0.95})
    return timed.groupBy("event_type").agg(
        F.min("lag").alias("min_lag"), F.max("lag").alias("max_lag"), F.avg("lag").alias("avg_lag")).join(middle, "event_type")
