"""Row counts, distributions, key checks and the tidy check report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixmart.functions import constants as C
from helixmart.functions.rules import round_half_up


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: Mapping[str, DataFrame], key: str = "table_name", value: str = "row_count") -> DataFrame:
    return _stack([df.agg(F.count("*").alias(value)).select(F.lit(name).alias(key), value)
                   for name, df in tables.items()])


def distribution(df: DataFrame, key: str) -> DataFrame:
    """Count and share per value; the total is a scalar subquery over the grouped rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("sample_count"))
    total = counts.agg(F.sum("sample_count")).scalar()
    return counts.withColumn("percentage", round_half_up(F.col("sample_count") * F.lit(100.0) / total, 1))


def gene_coverage(expression: DataFrame, genes: Sequence[str] = C.SUBTYPE_MARKERS) -> DataFrame:
    return expression.where(F.col("gene_symbol").isin(list(genes))).groupBy("gene_symbol").agg(
        F.countDistinct("sample_id").alias("sample_count"), F.avg("expression_value").alias("avg_expression"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of a declared unique key that occur more than once."""
    return (
        df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key_value"))
        .agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
        .select(F.lit(key).alias("key_name"), "key_value", "copies")
    )


def null_counts(df: DataFrame, table: str, required: Sequence[str]) -> DataFrame:
    """NULLs per required column, one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counted.unpivot([], list(required), "column_name", "null_rows").select(
        F.lit(table).alias("table_name"), "column_name", "null_rows")


def report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All checks as (check_name, key, value)."""

    def tidy(df: DataFrame, check: str, key: str, value: str) -> DataFrame:
        return df.select(
            F.lit(check).alias("check_name"), F.col(key).cast("string").alias("key"),
            F.col(value).cast("double").alias("value"))

    clinical, genomic = tables["mart_risk_features_clinical"], tables["mart_risk_features_genomic"]
    expression = tables["stg_gene_expression"]
    unmatched = (
        tables["stg_clinical"].join(expression, "sample_id", "left_anti")
        .agg(F.countDistinct("sample_id").alias("n")).withColumn("key", F.lit("clinical_only_samples"))
    )
    fan_out = tables["cell_lines"].groupBy("cell_line").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return _stack([
        tidy(row_counts(tables), "rows", "table_name", "row_count"),
        tidy(distribution(clinical, "target_category"), "share_by_category", "target_category", "percentage"),
        tidy(distribution(clinical, "is_male"), "share_by_sex", "is_male", "percentage"),
        tidy(distribution(genomic, "sclc_subtype"), "share_by_subtype", "sclc_subtype", "percentage"),
        tidy(gene_coverage(expression, C.CHECK_GENES), "samples_by_gene", "gene_symbol", "sample_count"),
        tidy(unmatched, "unmatched", "key", "n"),
        tidy(fan_out, "repeated_cell_line", "cell_line", "n"),
    ])


# -- checks that ride on other work ------------------------------------------------------------

#: What a build counts: landed tables and views, then the marts.
OBSERVED = [
    "cell_lines", "stg_clinical", "stg_gene_expression", "core_biomarkers", "mart_risk_features_clinical", "mart_risk_features_genomic",
    "mart_risk_features_combined", "mart_drug_sensitivity", "mart_drug_subtype_profile", "mart_treatment_recommendations",
    "mart_dose_response_summary",
]
#: Letters or digits, then those and . _ - only.
ID_FORMAT = "^[A-Z0-9][A-Z0-9._-]*$"


def _values(check: str, column: str, values: Sequence) -> dict[tuple[str, str], Column]:
    """Rows per known value of a column, and of all others."""
    known = {(check, str(v)): F.count_if(F.col(column) == v) for v in values}
    return known | {(check, "other"): F.count_if(F.col(column).isNull() | ~F.col(column).isin(list(values)))}


def _ids(check: str) -> dict[tuple[str, str], Column]:
    good = F.coalesce(F.col("sample_id").rlike(ID_FORMAT), F.lit(False))
    return {(check, "well_formed"): F.count_if(good), (check, "other"): F.count_if(~good)}


def observed_checks() -> dict[str, dict[tuple[str, str], Column]]:
    """table or view -> (check, key) -> aggregate. Counts only, so they can be observed while rows pass."""
    checks = {
        "cell_lines": _values("panel", "panel", [C.CELL_LINE_PANEL]),
        "stg_clinical": _ids("clinical_id_format"),
        "stg_gene_expression": _ids("expression_id_format"),
        # One row per sample: its genes that are there.
        "core_biomarkers": {("samples_by_gene", g): F.count(f"{g.lower()}_expr") for g in C.CHECK_GENES},
        "mart_risk_features_clinical": _values("category", "target_category", [label for _, _, label in C.SURVIVAL_BANDS]) | _values("is_male", "is_male", [0, 1]),
        "mart_risk_features_genomic": _values("subtype", "sclc_subtype", [*C.SUBTYPES, "MIXED"]),
        "mart_risk_features_combined": _values("has_genomic_data", "has_genomic_data", [0, 1]),
    }
    return {table: {("rows", table): F.count(F.lit(1))} | checks.get(table, {}) for table in OBSERVED}


def observed_report(spark: SparkSession, rows: Sequence[tuple[str, str, float]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "check_name string, key string, value double")
