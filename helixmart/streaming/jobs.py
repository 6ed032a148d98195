"""Event streams: sources, deduplication, live counts, sessions by silence, and file sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from helixmart.operators import events as E
from helixmart.streaming.silence import SCHEMA, SilenceSessions

TOPIC = "user_events"
#: Records that one trigger may take in the reference deployment; a ceiling of 167 records a second.
REFERENCE_RECORDS_PER_TRIGGER = 10_000
TRIGGER = "60 seconds"


def kafka_records(spark: SparkSession, servers: str, topic: str = TOPIC, records_per_trigger: int | None = None) -> DataFrame:
    """Topic to the two landing columns. Needs the Kafka package on the cluster.

    ``records_per_trigger`` limits a trigger's intake; without it each trigger takes what has arrived, so the job
    cannot fall behind the topic's retention by its own throttle.
    """
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if records_per_trigger is not None:
        source = source.option("maxOffsetsPerTrigger", records_per_trigger)
    raw = source.load()
    created = F.to_json(F.struct(F.unix_millis("timestamp").alias("CreateTime")))
    return raw.select(created.alias("record_metadata"), F.col("value").cast("string").alias("record_content"))


def file_records(spark: SparkSession, path: str) -> DataFrame:
    """Landed Parquet files of (record_metadata, record_content) as a stream."""
    return spark.readStream.schema("record_metadata string, record_content string").parquet(path)


def deduplicated(flat: DataFrame, delay: str = "1 hour") -> DataFrame:
    """At-least-once delivery to once; state is dropped behind the watermark."""
    return flat.withWatermark("app_timestamp", delay).dropDuplicatesWithinWatermark(["event_id"])


def live_usage(records: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return E.window_usage(deduplicated(E.flatten(records), delay), width)


def live_sessions(records: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    flat = deduplicated(E.flatten(records), delay)
    return flat.groupBy(F.session_window("app_timestamp", gap).alias("w"), "session_id").agg(
        F.count("*").alias("n_events")).select(
        "session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("closed_at"), "n_events")


def live_gap_sessions(records: DataFrame, gap: int = E.SESSION_GAP_SECONDS, delay: str = "1 hour") -> DataFrame:
    """Sessions per visitor by more than ``gap`` seconds of silence, each sent once when the watermark rules out that it
    goes on. Needs the RocksDB state store (``with_state_store``)."""
    flat = deduplicated(E.flatten(records).where(F.col("app_timestamp").isNotNull()), delay)
    seen = flat.select(E.visitor().alias("visitor"), "app_timestamp", F.unix_micros("app_timestamp").alias("at"))
    closed = seen.groupBy("visitor").transformWithState(SilenceSessions(gap), SCHEMA, "append", "EventTime")
    return closed.select("visitor", "session_no", F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("ended").alias("ended_at"), "n_events")


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession, run):
    """``run()`` while streams start with the store that timers need; the session's own setting comes back after."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        return run()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, over the query's recent batches."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def upsert_sink(stream: DataFrame, folder: str, checkpoint: str, once: bool = False) -> DataStreamWriter:
    """Changed rows of every batch in update mode, open windows too. A batch owns the folder of its number and overwrites
    it, so a batch that is run again after a failure changes nothing."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)


def upserted(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The table as of the last batch: for each key its row of the highest batch."""
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, "_last.*")


def compact(spark: SparkSession, folder: str, into: str, keys: Sequence[str]) -> None:
    """Write the current table to a new folder, as its batch -1, for readers of a long-running sink."""
    upserted(spark, folder, keys).write.mode("overwrite").parquet(f"{into}/batch=-1")


def file_sink(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> DataStreamWriter:
    """Parquet sink with exactly-once commits; ``once`` drains what is there and stops."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)


def drain_updates(stream: DataFrame, folder: str, keys: Sequence[str]) -> DataFrame:
    """Run the stream in update mode over everything available and read the table it keeps."""
    query = upsert_sink(stream, f"{folder}/out", f"{folder}/checkpoint", once=True).start()
    query.awaitTermination()
    return upserted(stream.sparkSession, f"{folder}/out", keys)


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run the stream over everything available and read back what it committed."""
    query = file_sink(stream, f"{folder}/out", f"{folder}/checkpoint", once=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
