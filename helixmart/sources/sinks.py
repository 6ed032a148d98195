"""Table writes and append-only ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def materialise(df: DataFrame, path: str, sort_within: list[str] | None = None) -> DataFrame:
    """Write a table as Parquet and return its stored form.

    Sorting inside partitions narrows the row-group ranges that later filters skip by.
    """
    (df.sortWithinPartitions(*sort_within) if sort_within else df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append processed marks with their time; callers anti-join the ledger first, so a rerun adds nothing."""
    rows.withColumn("processed_at", F.current_timestamp()).write.mode("append").parquet(path)
