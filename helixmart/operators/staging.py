"""Cleaned views over the landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixmart.functions import constants as C
from helixmart.functions.rules import band, first_like, norm_key, to_bigint, to_double

_SMOKING = [("%Current%", "CURRENT"), ("%Former%", "FORMER"), ("%Never%", "NEVER")]
# The default order lets "I%" take every stage that starts with I.
_STAGES = [("I%", "STAGE_I"), ("II%", "STAGE_II"), ("III%", "STAGE_III"), ("IV%", "STAGE_IV")]
_STAGES_CORRECTED = [("IV%", "STAGE_IV"), ("III%", "STAGE_III"), ("II%", "STAGE_II"), ("I%", "STAGE_I")]


def clinical(raw: DataFrame, corrected: bool = False) -> DataFrame:
    """One row per sample with bands and cleaned keys; rows without a sample id are dropped."""
    status = F.col("overall_survival_status")
    return raw.where(F.col("sample_id").isNotNull()).select(
        norm_key(F.col("sample_id")).alias("sample_id"),
        norm_key(F.col("patient_id")).alias("patient_id"),
        "study_id",
        to_bigint(F.col("diagnosis_age")).alias("diagnosis_age"),
        "sex",
        band(to_bigint(F.col("diagnosis_age")), C.AGE_BANDS).alias("age_group"),
        first_like([F.col("smoker"), F.col("smoking_history")], _SMOKING, "UNKNOWN").alias("smoking_status"),
        F.coalesce(to_bigint(F.col("mutation_count")), F.lit(0)).cast("bigint").alias("mutation_count"),
        F.coalesce(to_double(F.col("tmb_nonsynonymous")), F.lit(0.0)).alias("tmb"),
        band(to_double(F.col("tmb_nonsynonymous")), C.TMB_BANDS, "UNKNOWN").alias("tmb_category"),
        "stage_at_diagnosis",
        first_like([F.col("stage_at_diagnosis")], _STAGES_CORRECTED if corrected else _STAGES, "UNKNOWN")
        .alias("stage_group"),
        to_double(F.col("overall_survival_months")).alias("overall_survival_months"),
        F.when(status.like("%DECEASED%"), 1).when(status.like("%LIVING%"), 0).alias("survival_event"),
        band(to_double(F.col("overall_survival_months")), C.SURVIVAL_BANDS).alias("survival_category"),
    )


def gene_rows(raw: DataFrame) -> DataFrame:
    """Cleaned keys and value, which is all that the marts read."""
    value = to_double(F.col("expression_value"))
    kept = F.col("gene_symbol").isNotNull() & F.col("sample_id").isNotNull() & value.isNotNull()
    return raw.where(kept).select(
        norm_key(F.col("gene_symbol")).alias("gene_symbol"),
        norm_key(F.col("sample_id")).alias("sample_id"),
        value.alias("expression_value"),
    )


def graded(rows: DataFrame) -> DataFrame:
    """``gene_rows`` with logarithm and level."""
    value = F.col("expression_value")
    return rows.select(
        "gene_symbol", "sample_id", "expression_value",
        F.when(value > 0, F.log2(value)).alias("log2_expression"),
        band(value, C.EXPRESSION_BANDS).alias("expression_level"),
    )


def gene_expression(raw: DataFrame) -> DataFrame:
    return graded(gene_rows(raw))


def experiments(raw: DataFrame) -> DataFrame:
    log_ic50 = to_double(F.col("log_ic50"))
    kept = F.col("experiment_id").isNotNull() & F.col("nsc").isNotNull() & F.col("cell_line").isNotNull()
    return raw.where(kept).select(
        to_bigint(F.col("experiment_id")).alias("experiment_id"),
        to_bigint(F.col("nsc")).alias("nsc"),
        norm_key(F.col("cell_line")).alias("cell_line"),
        *[
            to_double(F.col(name)).alias(name)
            for name in ("highest_tested_concentration", "log_ec50", "response_zero",
                         "response_inflection", "hill_slope")
        ],
        log_ic50.alias("log_ic50"),
        F.trim("flag_ic50").alias("flag_ic50"),
        F.pow(F.lit(10.0), log_ic50).alias("ic50_um"),
        band(log_ic50, C.SENSITIVITY_BANDS, "UNKNOWN").alias("sensitivity_category"),
    )


def dose_response(raw: DataFrame) -> DataFrame:
    concentration, mean, spread = (
        to_double(F.col(name)) for name in ("concentration", "mean_pct_ctrl", "stddev_pct_ctrl")
    )
    variation = F.abs(spread / F.nullif(mean, F.lit(0.0))) * 100
    kept = (
        F.col("experiment_id").isNotNull() & F.col("concentration").isNotNull() & F.col("mean_pct_ctrl").isNotNull()
    )
    return raw.where(kept).select(
        to_bigint(F.col("experiment_id")).alias("experiment_id"),
        concentration.alias("concentration"),
        mean.alias("mean_pct_ctrl"),
        spread.alias("stddev_pct_ctrl"),
        to_bigint(F.col("count_pct_ctrl")).alias("count_pct_ctrl"),
        F.when(concentration > 0, F.log10(concentration)).alias("log_concentration"),
        variation.alias("coefficient_variation"),
        # A zero mean has no variation and falls through to LOW.
        F.when(spread.isNull(), "NO_STDDEV")
        .when(variation > 30, "HIGH_VARIABILITY")
        .when(variation > 15, "MODERATE_VARIABILITY")
        .otherwise("LOW_VARIABILITY")
        .alias("data_quality_flag"),
        band(mean, C.RESPONSE_BANDS, "UNKNOWN").alias("response_category"),
    )


def compounds(raw: DataFrame) -> DataFrame:
    return raw.select(
        to_bigint(F.col("nsc")).alias("nsc"), F.trim("cas").alias("cas"), F.trim("drug_name").alias("drug_name")
    )


def cell_lines(raw: DataFrame) -> DataFrame:
    return raw.select(norm_key(F.col("cell_line")).alias("cell_line"), F.trim("panel").alias("panel"))


def cell_line_subtypes(raw: DataFrame) -> DataFrame:
    """Subtype of each small-cell line, looked up by the name as written."""
    name, subtype = F.col("cell_line"), F
    for label, lines in C.CELL_LINE_SUBTYPES.items():
        subtype = subtype.when(name.isin(lines), label)
    return raw.where(F.col("panel") == C.CELL_LINE_PANEL).select(
        norm_key(name).alias("cell_line"),
        F.trim("panel").alias("panel"),
        subtype.otherwise("UNKNOWN").alias("inferred_subtype"),
    )
