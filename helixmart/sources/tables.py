"""Readers for the landed tables and the lazy view layer over one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixmart import schemas
from helixmart.sources.adapters import ADAPTERS, BASE_TABLES


def load_raw(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A landed table under its declared schema."""
    reader = spark.read.schema(schemas.RAW[name])
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(f"{folder}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select and cast to the declared schema of ``name``."""
    fields = [part.strip().split(" ") for part in schemas.RAW[name].split(",")]
    return df.select(*[F.col(column).cast(kind).alias(column) for column, kind in fields])


def base_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def adapted(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Run one adapter text over the Parquet files of ``folder``."""
    text = ADAPTERS[name]
    for table in BASE_TABLES:
        if f" {table} " in text.replace("\n", " ") + " ":
            base_table(spark, folder, table).createOrReplaceTempView(table)
    df = spark.sql(text)
    return conform(df, name) if name in schemas.RAW else df
