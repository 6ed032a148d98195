"""Streams against their batch twins, with duplicates and late rows."""

import json

from pyspark.sql import functions as F

from helixmart.operators import events as E
from helixmart.streaming import jobs


def record(i, when, event="button_click", status="success", **more):
    body = {"event_id": str(i), "event_type": event, "timestamp": when, "user_type": "user", "user_id": "7", "status": status, **more}
    return (json.dumps({"CreateTime": 1704067200000}), json.dumps(body))


def write(spark, rows, path):
    spark.createDataFrame(rows, "record_metadata string, record_content string").coalesce(1).write.mode("append").parquet(path)


def test_duplicates_and_late_rows(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    rows = [record(i, f"2024-01-01T0{h}:{m:02d}:00Z") for i, (h, m) in enumerate([(1, 0), (1, 30), (2, 10), (5, 0)])]
    write(spark, rows + rows[:2], source)
    first = jobs.drain(jobs.live_usage(jobs.file_records(spark, source)), folder)
    closed = {r["window_start"].hour: r["n"] for r in first.collect()}
    assert closed == {1: 2, 2: 1}  # duplicates counted once, the open window is held back
    # two hours late and behind the watermark: dropped; a sentinel closes hour 5
    write(spark, [record(90, "2024-01-01T01:10:00Z"), record(91, "2024-01-01T09:00:00Z")], source)
    again = jobs.drain(jobs.live_usage(jobs.file_records(spark, source)), folder)
    closed = {r["window_start"].hour: r["n"] for r in again.collect()}
    assert closed == {1: 2, 2: 1, 5: 1}


def test_stream_equals_batch_without_late_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, [record(i, f"2024-01-01T{i % 20:02d}:15:00Z", status="failure" if i % 3 else "success") for i in range(60)], source)
    streamed = jobs.drain(E.flatten(jobs.file_records(spark, source)), str(tmp_path / "run"))
    batch = E.flatten(spark.read.parquet(source))
    assert streamed.exceptAll(batch).isEmpty()
    assert streamed.count() == batch.count() == 60


def test_missing_fields_are_null(spark):
    df = spark.createDataFrame([('{"CreateTime": 1000}', '{"event_id": 5}'), ("{}", "not json")], "record_metadata string, record_content string")
    rows = E.flatten(df).collect()
    assert rows[0]["event_id"] == "5" and rows[0]["session_id"] is None and rows[0]["app_timestamp"] is None
    assert rows[1]["event_id"] is None and rows[1]["kafka_ingest_timestamp"] is None


def test_live_sessions(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, [record(1, "2024-01-01T01:00:00Z", session_id="a"), record(2, "2024-01-01T01:20:00Z", session_id="a"),
                  record(3, "2024-01-01T02:20:00Z", session_id="a"), record(4, "2024-01-01T09:00:00Z", session_id="b")], source)
    rows = jobs.drain(jobs.live_sessions(jobs.file_records(spark, source)), str(tmp_path / "run")).collect()
    assert sorted(r["n_events"] for r in rows) == [1, 2]


def test_variant_landing_columns(spark):
    df = spark.createDataFrame([record(1, "2024-01-01T01:00:00Z")], "record_metadata string, record_content string")
    typed = df.select(F.parse_json("record_metadata").alias("record_metadata"), F.parse_json("record_content").alias("record_content"))
    assert E.flatten(typed).collect() == E.flatten(df).collect()


def closed(rows):
    return sorted((r["visitor"], r["session_no"], r["started_at"].strftime("%d %H:%M"), r["ended_at"].strftime("%d %H:%M"), r["n_events"]) for r in rows)


def run(spark, source, folder):
    stream = jobs.live_gap_sessions(jobs.file_records(spark, source))

    def go():
        query = jobs.file_sink(stream, f"{folder}/out", f"{folder}/checkpoint", once=True).start()
        query.awaitTermination()
        return jobs.dropped_late(query)

    late = jobs.with_state_store(spark, go)
    return late, closed(spark.read.schema(stream.schema).parquet(f"{folder}/out").collect())


def test_sessions_by_silence_over_batches(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    nobody = {"user_id": "anonymous", "session_id": "unknown"}
    first = [record(1, "2024-01-01T01:00:00Z"), record(2, "2024-01-01T01:50:00Z"), record(3, "2024-01-01T01:05:00Z", **nobody),
             record(4, "2024-01-01T01:00:00Z", user_id="anonymous", session_id="s1")]
    write(spark, first + first[:1], source)
    assert run(spark, source, folder) == (0, [])
    # Out of order: 01:25 unites 01:00 and 01:50; an event at 04:10 moves the watermark to 03:10 and closes what is silent.
    write(spark, [record(5, "2024-01-01T01:25:00Z"), record(6, "2024-01-01T04:10:00Z"), record(7, "2024-01-01T03:30:00Z", **nobody)], source)
    late, rows = run(spark, source, folder)
    assert late == 0
    assert rows == [("7", 1, "01 01:00", "01 01:50", 3), ("anonymous", 1, "01 01:05", "01 01:05", 1), ("session s1", 1, "01 01:00", "01 01:00", 1)]
    # Behind the watermark: dropped and counted; the rest closes at the end.
    write(spark, [record(8, "2024-01-01T01:55:00Z"), record(9, "2024-01-02T09:00:00Z", user_id="end")], source)
    late, rows = run(spark, source, folder)
    assert late >= 1
    assert rows[:2] == [("7", 1, "01 01:00", "01 01:50", 3), ("7", 2, "01 04:10", "01 04:10", 1)]
    assert ("anonymous", 2, "01 03:30", "01 03:30", 1) in rows and len(rows) == 5


def test_sessions_take_few_calls_of_the_state_store():
    from helixmart.streaming.silence import SilenceSessions

    calls, value, minute = [], [None], 60_000_000

    class Store:
        def getValueState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return value[0]

        def update(self, new):
            calls.append("update")
            value[0] = new

        def registerTimer(self, at):
            calls.append(("register", at))

        def deleteTimer(self, at):
            calls.append(("delete", at))

    class Now:
        def getCurrentWatermarkInMs(self):
            return 100 * 60_000

    sessions = SilenceSessions(30 * 60)
    sessions.init(Store())
    send = lambda *minutes: list(sessions.handleInputRows(("v",), iter([{"at": m * minute} for m in minutes]), None))
    assert send(0, 95, 5) == [] and calls == ["get", "update", ("register", 35 * 60_000 + 1)]
    calls.clear()
    send(20)  # prolongs the first session, so its timer moves
    assert calls == ["get", "update", ("delete", 35 * 60_000 + 1), ("register", 50 * 60_000 + 1)]
    calls.clear()
    out = list(sessions.handleExpiredTimer(("v",), Now(), None))
    assert [tuple(r) for r in out] == [("v", 1, 0, 20 * minute, 3)]
    assert calls == ["get", "update", ("register", 125 * 60_000 + 1)]


def test_open_windows_and_replay(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    keys = ["window_start", "window_end", "event_type", "status"]
    write(spark, [record(i, f"2024-01-01T0{h}:{m:02d}:00Z") for i, (h, m) in enumerate([(1, 0), (1, 30), (2, 10), (5, 0)])], source)
    stream = jobs.live_usage(jobs.file_records(spark, source))
    first = jobs.drain_updates(stream, folder, keys)
    assert {r["window_start"].hour: r["n"] for r in first.collect()} == {1: 2, 2: 1, 5: 1}
    write(spark, [record(50, "2024-01-01T05:20:00Z"), record(51, "2024-01-01T06:00:00Z")], source)
    stream = jobs.live_usage(jobs.file_records(spark, source))
    again = jobs.drain_updates(stream, folder, keys)
    want = {1: 2, 2: 1, 5: 2, 6: 1}
    assert {r["window_start"].hour: r["n"] for r in again.collect()} == want
    batch = E.window_usage(E.flatten(spark.read.parquet(source)))
    assert again.select(*batch.columns).exceptAll(batch).isEmpty() and again.count() == batch.count()
    # A batch that is written again, as after a failure between write and commit, changes nothing.
    number = again.sparkSession.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/batch=*").agg(F.max("batch")).first()[0]
    rows = spark.read.parquet(f"{folder}/out/batch={number}").collect()
    spark.createDataFrame(rows, stream.schema).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    after = jobs.upserted(spark, f"{folder}/out", keys)
    assert {r["window_start"].hour: r["n"] for r in after.collect()} == want
    jobs.compact(spark, f"{folder}/out", f"{folder}/small", keys)
    assert {r["window_start"].hour: r["n"] for r in jobs.upserted(spark, f"{folder}/small", keys).collect()} == want
