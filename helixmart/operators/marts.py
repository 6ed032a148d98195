"""Feature, drug and recommendation marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helixmart.functions import constants as C, markers as M
from helixmart.functions.rules import band, flag, one_hot, round_half_up, share, zero
from helixmart.operators.ranking import GATHERED, by_group_size, group_quantiles, quantile_of_sorted


def biomarkers(expression: DataFrame) -> DataFrame:
    """Twelve genes as columns (highest value per sample) in one shuffle, plus the subtype call."""
    pivoted = (
        expression.where(F.col("gene_symbol").isin(C.BIOMARKERS))
        .groupBy("sample_id")
        .agg(*[
            F.max(F.when(F.col("gene_symbol") == gene, F.col("expression_value"))).alias(f"{gene.lower()}_expr")
            for gene in C.BIOMARKERS
        ])
    )
    markers = {gene: zero(F.col(f"{gene.lower()}_expr")) for gene in C.SUBTYPE_MARKERS}
    return pivoted.select(
        "*",
        M.subtype_call(markers).alias("sclc_subtype"),
        F.greatest(*[zero(F.col(f"{g}_expr")) for g in ("myc", "mycl", "mycn")]).alias("myc_family_score"),
        M.dual_loss(F.col("tp53_expr"), F.col("rb1_expr")).alias("tp53_rb1_dual_loss"),
    )


def gene_moments(expression: DataFrame) -> DataFrame:
    """Distinct genes, mean and sample deviation per sample."""
    return expression.groupBy("sample_id").agg(
        F.countDistinct("gene_symbol").alias("total_genes_expressed"),
        F.avg("expression_value").alias("mean_gene_expression"),
        F.stddev_samp("expression_value").alias("stddev_gene_expression"),
    )


def gene_summary(expression: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """Moments and the exact median per sample. A sample of at most ``gathered`` rows gets all of them in one grouping."""
    small, large = by_group_size(expression, ["sample_id"], gathered)
    value = F.col("expression_value").cast("double")
    together = small.groupBy("sample_id").agg(
        F.size(F.collect_set("gene_symbol")).cast("bigint").alias("total_genes_expressed"),
        F.avg("expression_value").alias("mean_gene_expression"),
        F.stddev_samp("expression_value").alias("stddev_gene_expression"),
        F.sort_array(F.collect_list(F.when(F.abs(value) < float("inf"), value))).alias("_s"),
    ).withColumn("median_gene_expression", quantile_of_sorted(F.col("_s"), 0.5)).drop("_s")
    middle = group_quantiles(large, ["sample_id"], "expression_value", {"median_gene_expression": 0.5})
    return together.unionByName(gene_moments(large).join(middle, "sample_id", "left"))


def risk_features_clinical(staged: DataFrame) -> DataFrame:
    advanced = F.col("stage_group").isin("STAGE_III", "STAGE_IV")
    current = F.col("smoking_status") == "CURRENT"
    return staged.where(F.col("overall_survival_months").isNotNull()).select(
        "sample_id", "patient_id", "study_id",
        F.col("overall_survival_months").alias("target_survival_months"),
        F.col("survival_event").alias("target_event"),
        F.col("survival_category").alias("target_category"),
        F.col("diagnosis_age").alias("age"),
        "age_group",
        *one_hot(F.col("sex"), {"is_male": "Male"}),
        "smoking_status",
        *one_hot(F.col("smoking_status"), {
            "is_current_smoker": "CURRENT", "is_former_smoker": "FORMER", "is_never_smoker": "NEVER"}),
        "mutation_count", "tmb", "tmb_category",
        *one_hot(F.col("tmb_category"), {
            "is_tmb_high": "TMB_HIGH", "is_tmb_intermediate": "TMB_INTERMEDIATE", "is_tmb_low": "TMB_LOW"}),
        "stage_group", "stage_at_diagnosis",
        *one_hot(F.col("stage_group"), {
            "is_stage_i": "STAGE_I", "is_stage_ii": "STAGE_II",
            "is_stage_iii": "STAGE_III", "is_stage_iv": "STAGE_IV"}),
        flag(advanced).alias("is_advanced_stage"),
        (F.col("diagnosis_age") * flag(advanced)).alias("age_x_advanced_stage"),
        (flag(current) * F.col("tmb")).alias("smoker_x_tmb"),
        flag(advanced & (F.col("tmb") < 6) & (F.col("diagnosis_age") > 65)).alias("high_risk_flag"),
        F.lit("CLINICAL_COHORT").alias("cohort_type"),
    )


def genomic_features(core: DataFrame, corrected: bool = False) -> DataFrame:
    """Everything in the genomic mart that needs no per-sample summary: subtype, markers, targets, flags.

    Jobs that read only these columns use this form and spare the summary's scans.
    """
    markers = {gene: zero(F.col(f"{gene.lower()}_expr")) for gene in C.SUBTYPE_MARKERS}
    known = F.col("sclc_subtype").isNotNull() & (F.col("sclc_subtype") != "MIXED")
    return core.where(known).select(
        "sample_id", "sclc_subtype",
        *one_hot(F.col("sclc_subtype"), {f"is_sclc_{s[-1].lower()}": s for s in C.SUBTYPES}),
        *[zero(F.col(f"{g.lower()}_expr")).alias(f"{g.lower()}_expression") for g in C.BIOMARKERS],
        "myc_family_score", "tp53_rb1_dual_loss",
        F.greatest(*markers.values()).alias("dominant_subtype_marker_expr"),
        M.confidence_gap(markers, corrected).alias("subtype_confidence_score"),
        flag(F.col("dll3_expr") >= 5).alias("dll3_targetable"),
        flag(F.col("bcl2_expr") >= 5).alias("bcl2_targetable"),
        flag(F.col("myc_family_score") >= 10).alias("myc_amplified"),
        flag((F.col("tp53_rb1_dual_loss") == 1) & (F.col("myc_family_score") > 10)).alias("genomic_high_risk_flag"),
        F.lit("GENOMIC_COHORT").alias("cohort_type"),
    )


_SUMMARY_COLUMNS = {
    "genes_expressed": "total_genes_expressed", "mean_expression": "mean_gene_expression",
    "stddev_expression": "stddev_gene_expression", "median_expression": "median_gene_expression",
}


def risk_features_genomic(features: DataFrame, summary: DataFrame) -> DataFrame:
    """Genomic features with the summary columns that ``summary`` has; missing samples get 0."""
    added = {name: F.coalesce(source, F.lit(0)).alias(name) for name, source in _SUMMARY_COLUMNS.items()
             if source in summary.columns}
    return features.join(summary, "sample_id", "left").select(*features.columns, *added.values())


COMBINED_CLINICAL = [
    "patient_id", "study_id", "target_survival_months", "target_event", "target_category", "age",
    "age_group", "is_male", "smoking_status", "is_current_smoker", "is_former_smoker", "is_never_smoker",
    "mutation_count", "tmb", "tmb_category", "is_tmb_high", "is_tmb_intermediate", "is_tmb_low",
    "stage_group", "is_advanced_stage", "age_x_advanced_stage", "smoker_x_tmb", "high_risk_flag",
]
COMBINED_GENOMIC = [
    "sclc_subtype", "is_sclc_a", "is_sclc_n", "is_sclc_p", "is_sclc_y", "ascl1_expression",
    "neurod1_expression", "pou2f3_expression", "yap1_expression", "tp53_expression", "rb1_expression",
    "myc_family_score", "tp53_rb1_dual_loss", "dll3_targetable", "bcl2_targetable", "myc_amplified",
    "mean_expression", "genomic_high_risk_flag",
]


def risk_features_combined(clinical: DataFrame, genomic: DataFrame) -> DataFrame:
    """Clinical rows with genomic columns where the sample has them."""
    right = genomic.select("sample_id", *COMBINED_GENOMIC, F.lit(True).alias("_found"))
    found = F.col("_found").isNotNull()
    return clinical.select("sample_id", *COMBINED_CLINICAL).join(right, "sample_id", "left").select(
        "sample_id", *COMBINED_CLINICAL, *COMBINED_GENOMIC,
        flag(found).alias("has_genomic_data"),
        F.when(found, "CLINICAL_AND_GENOMIC").otherwise("CLINICAL_ONLY").alias("data_source"),
    )


def drug_sensitivity(experiments: DataFrame, compounds: DataFrame, cell_lines: DataFrame) -> DataFrame:
    """Experiments with an IC50, with drug and panel; duplicate keys fan out.

    No broadcast hint: both lookups may grow, so the planner decides by size.
    """
    return (
        experiments.where(F.col("ic50_um").isNotNull())
        .join(compounds, "nsc", "left")
        .join(cell_lines, "cell_line", "left")
        .select(
            "experiment_id", "nsc", "drug_name", "cas", "cell_line", "panel", "ic50_um", "log_ic50",
            "log_ec50", "sensitivity_category", "hill_slope", "response_zero", "response_inflection",
            band(F.col("log_ic50"), C.EFFICACY_BANDS, C.EFFICACY_REST).alias("efficacy_score"),
            F.abs(F.col("response_inflection") - F.col("response_zero")).alias("response_magnitude"),
        )
    )


def drug_subtype_profile(sensitivity: DataFrame, subtypes: DataFrame) -> DataFrame:
    """One row per drug and subtype: spread of IC50, sensitivity counts and the rating."""

    def seen(category: str) -> Column:
        return F.sum(flag(F.col("sensitivity_category") == category)).cast("bigint")

    mapped = subtypes.where(F.col("inferred_subtype") != "UNKNOWN").select(
        "cell_line", F.col("inferred_subtype").alias("sclc_subtype")
    )
    rolled = sensitivity.join(mapped, "cell_line").groupBy("nsc", "drug_name", "sclc_subtype").agg(
        F.countDistinct("cell_line").alias("num_cell_lines_tested"),
        F.avg("ic50_um").alias("avg_ic50_um"),
        F.avg("log_ic50").alias("avg_log_ic50"),
        F.min("ic50_um").alias("min_ic50_um"),
        F.max("ic50_um").alias("max_ic50_um"),
        F.avg("efficacy_score").alias("avg_efficacy_score"),
        F.avg("response_magnitude").alias("avg_response_magnitude"),
        seen("HIGHLY_SENSITIVE").alias("highly_sensitive_count"),
        seen("SENSITIVE").alias("sensitive_count"),
        seen("MODERATELY_RESISTANT").alias("moderate_resistant_count"),
        seen("RESISTANT").alias("resistant_count"),
    )
    half = F.col("num_cell_lines_tested") * F.lit(0.5)
    spread = F.round(F.col("max_ic50_um") - F.col("min_ic50_um"), 12)
    return rolled.where(F.col("num_cell_lines_tested") >= 1).select(
        "*",
        F.when(F.col("highly_sensitive_count") >= half, "HIGHLY_EFFECTIVE")
        .when(F.col("highly_sensitive_count") + F.col("sensitive_count") >= half, "EFFECTIVE")
        .when(F.col("moderate_resistant_count") >= half, "MODERATELY_EFFECTIVE")
        .otherwise("LOW_EFFECTIVENESS")
        .alias("subtype_effectiveness"),
        F.when(spread < 1e-5, "HIGHLY_CONSISTENT").when(spread < 1e-4, "CONSISTENT").otherwise("VARIABLE")
        .alias("response_consistency"),
        round_half_up(F.col("avg_efficacy_score") * 0.6 + F.col("avg_response_magnitude") * 0.4, 2)
        .alias("recommendation_score"),
    )


def top_drugs(profile: DataFrame, per_subtype: int = C.DRUGS_PER_SUBTYPE) -> DataFrame:
    """Best effective drugs per subtype; the rank limit runs before and after the shuffle."""
    order = W.partitionBy("sclc_subtype").orderBy(
        F.desc_nulls_first("recommendation_score"), F.desc_nulls_first("avg_efficacy_score"),
        F.asc_nulls_last("nsc"), F.asc_nulls_last("drug_name"),
    )
    return (
        profile.where(F.col("subtype_effectiveness").isin(C.EFFECTIVE))
        .withColumn("drug_rank", F.row_number().over(order))
        .where(F.col("drug_rank") <= per_subtype)
        .select(
            "sclc_subtype", "nsc", "drug_name", "avg_ic50_um", "avg_efficacy_score", "subtype_effectiveness",
            "recommendation_score", "num_cell_lines_tested", "drug_rank",
        )
    )


def treatment_recommendations(genomic: DataFrame, drugs: DataFrame) -> DataFrame:
    """Every typed patient with the best drugs of the subtype.

    ``drugs`` comes from ``top_drugs``: at most four subtypes times ten rows, hence
    the broadcast.
    """
    name, rank, score = F.col("drug_name"), F.col("drug_rank"), F.col("recommendation_score")
    return genomic.join(F.broadcast(drugs), "sclc_subtype").select(
        "sample_id", "sclc_subtype", "cohort_type",
        "ascl1_expression", "neurod1_expression", "pou2f3_expression", "yap1_expression",
        "myc_family_score", "tp53_rb1_dual_loss", "dll3_targetable", "bcl2_targetable",
        "myc_amplified", "genomic_high_risk_flag",
        "drug_rank", "nsc", "drug_name", "avg_ic50_um", "avg_efficacy_score",
        "subtype_effectiveness", "recommendation_score", "num_cell_lines_tested",
        F.when((F.col("dll3_targetable") == 1) & name.like("%Rovalpituzumab%"),
               "DLL3-targeted therapy recommended")
        .when((F.col("bcl2_targetable") == 1) & name.like("%Venetoclax%"),
              "BCL2 inhibitor therapy recommended")
        .when(F.col("myc_amplified") == 1, "MYC amplification detected - consider targeted therapy")
        .when(F.col("genomic_high_risk_flag") == 1, "High genomic risk - aggressive treatment recommended")
        .otherwise("Standard subtype-based treatment")
        .alias("treatment_rationale"),
        F.when((rank <= 3) & (score >= 70), "HIGH_PRIORITY")
        .when((rank <= 5) & (score >= 60), "MEDIUM_PRIORITY")
        .otherwise("CONSIDER")
        .alias("recommendation_priority"),
    )


def dose_response_summary(doses: DataFrame, experiments: DataFrame) -> DataFrame:
    """One row per curve with quality class, joined to the experiments of that id."""

    def points(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value)

    curves = doses.groupBy("experiment_id").agg(
        F.count("*").alias("num_dose_points"),
        F.min("concentration").alias("min_concentration"),
        F.max("concentration").alias("max_concentration"),
        F.min("mean_pct_ctrl").alias("min_response"),
        F.max("mean_pct_ctrl").alias("max_response"),
        F.avg("mean_pct_ctrl").alias("avg_response"),
        F.avg("coefficient_variation").alias("avg_cv"),
        points("data_quality_flag", "LOW_VARIABILITY").alias("low_variability_points"),
        points("data_quality_flag", "HIGH_VARIABILITY").alias("high_variability_points"),
        points("response_category", "STRONG_INHIBITION").alias("strong_inhibition_points"),
        points("response_category", "MODERATE_INHIBITION").alias("moderate_inhibition_points"),
        points("response_category", "WEAK_INHIBITION").alias("weak_inhibition_points"),
        points("response_category", "MINIMAL_EFFECT").alias("minimal_effect_points"),
    ).withColumn("response_range", F.col("max_response") - F.col("min_response"))
    n, width = F.col("num_dose_points"), F.col("response_range")
    noisy = share(F.col("high_variability_points"), n)
    steady = share(F.col("low_variability_points"), n)
    screened = experiments.select("experiment_id", "nsc", "cell_line", "ic50_um", "log_ic50", "sensitivity_category")
    return curves.join(screened, "experiment_id", "left").select(
        "*",
        round_half_up(
            steady * 40
            + F.when(width > 50, F.lit(30.0)).otherwise(width * 0.6)
            + F.when(n >= 8, 30).when(n >= 5, 20).otherwise(10),
            2,
        ).alias("curve_quality_score"),
        F.when(noisy > 0.3, "POOR_QUALITY")
        .when(width < 30, "LOW_DYNAMIC_RANGE")
        .when(n < 5, "INSUFFICIENT_POINTS")
        .when((steady > 0.7) & (width > 50), "HIGH_QUALITY")
        .otherwise("ACCEPTABLE_QUALITY")
        .alias("curve_quality_classification"),
        F.when(noisy > 0.3, "USE_WITH_CAUTION").when(width < 30, "VERIFY_ACTIVITY").otherwise("RELIABLE")
        .alias("data_reliability"),
    )
