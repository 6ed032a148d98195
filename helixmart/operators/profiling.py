"""Shape, missing values and value frequencies of any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from helixmart.functions.constants import PROFILE_KEYWORDS


def profile(df: DataFrame) -> DataFrame:
    """Rows, columns and missing cells in one pass."""
    missing = F.lit(0)
    for name in df.columns:
        missing = missing + F.col(name).isNull().cast("int")
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.coalesce(F.sum(missing), F.lit(0)).cast("bigint").alias("missing_cells"),
    )


def keyword_columns(columns: Sequence[str], keywords: Sequence[str] = PROFILE_KEYWORDS) -> list[str]:
    return [name for name in columns if any(word in name.lower() for word in keywords)]


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for several text columns: one unpivot, one partial aggregate."""
    long = df.unpivot([], list(columns), "column_name", "value").where(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def column_profile(df: DataFrame, columns: Sequence[str], top: int = 3) -> DataFrame:
    """Distinct values per column and its most frequent ones."""
    counts = value_counts(df, columns)
    distinct = counts.groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    order = W.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    best = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return best.join(distinct, "column_name")
