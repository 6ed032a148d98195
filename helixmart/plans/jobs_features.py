"""Jobs over staging views and marts: projections, joins, aggregates, windows, sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixmart import schemas
from helixmart.functions import constants as C, markers as M
from helixmart.functions.rules import round_half_up
from helixmart.operators import lookups, marts, profiling, quality, staging
from helixmart.plans.check_views import bit, pick, rnd
from helixmart.plans.registry import job
from helixmart.plans.warehouse import build_observed
from helixmart.session import scratch_dir


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({
        name: round_half_up(F.col(name), n, 20 if n > 12 else 12) for name, n in digits.items()})


def replaced(digits: dict[str, int]) -> str:
    return ", ".join(f"{rnd(name, n, 20 if n > 12 else 12)} AS {name}" for name, n in digits.items())


def _ordered(df, order: list[str] | None):
    return df.orderBy(*order) if order else df


def table_job(name: str, table: str, digits: dict[str, int] | None = None, order: list[str] | None = None) -> None:
    """The whole table or model, with computed doubles rounded on both sides; extracts state an order."""
    star = f"* REPLACE ({replaced(digits)})" if digits else "*"
    job(name, f"SELECT {star} FROM {table}" + (f" ORDER BY {', '.join(order)}" if order else ""))(
        lambda w: _ordered(rounded(w[table], digits) if digits else w[table], order))


_SUMMARY = {"genes_expressed", "mean_expression", "stddev_expression", "median_expression"}


def columns_job(name: str, table: str, columns: list[str], digits: dict[str, int] | None = None, order: list[str] | None = None) -> None:
    digits = digits or {}
    source = "genomic_features" if table == "mart_risk_features_genomic" and not _SUMMARY & set(columns) else table
    wanted = ", ".join(rnd(c, digits[c], 20 if digits[c] > 12 else 12) + f" AS {c}" if c in digits else c for c in columns)
    job(name, f"SELECT {wanted} FROM {table}" + (f" ORDER BY {', '.join(order)}" if order else ""))(
        lambda w: _ordered(rounded(w[source].select(*columns), digits), order))


# -- models, whole -------------------------------------------------------------------------

_GENOMIC_DIGITS = {"mean_expression": 9, "stddev_expression": 9, "median_expression": 9}
_DOSE_DIGITS = {"avg_response": 9, "avg_cv": 9, "ic50_um": 15}
_PROFILE_DIGITS = {"avg_ic50_um": 15, "avg_log_ic50": 9, "min_ic50_um": 15, "max_ic50_um": 15,
                   "avg_efficacy_score": 9, "avg_response_magnitude": 9}
table_job("model_stg_clinical", "stg_clinical")
table_job("model_stg_gene_expression", "stg_gene_expression", {"log2_expression": 9})
table_job("model_stg_experiments", "stg_experiments", {"ic50_um": 15})
table_job("model_stg_dose_response", "stg_dose_response", {"log_concentration": 9, "coefficient_variation": 9})
table_job("model_mart_risk_features_clinical", "mart_risk_features_clinical")
job("model_core_biomarkers", "SELECT * EXCLUDE (top, leaders) FROM core_biomarkers")(lambda w: w["core_biomarkers"])
table_job("model_mart_risk_features_genomic", "mart_risk_features_genomic", _GENOMIC_DIGITS)
table_job("model_mart_risk_features_combined", "mart_risk_features_combined", {"mean_expression": 9})
table_job("model_mart_drug_sensitivity", "mart_drug_sensitivity", {"ic50_um": 15})
table_job("model_mart_drug_subtype_profile", "mart_drug_subtype_profile", _PROFILE_DIGITS)
table_job("model_mart_treatment_recommendations", "mart_treatment_recommendations",
          {"avg_ic50_um": 15, "avg_efficacy_score": 9})
table_job("model_mart_dose_response_summary", "mart_dose_response_summary", _DOSE_DIGITS)

# -- A: scans and extracts -----------------------------------------------------------------

for _name in schemas.RAW:
    table_job(f"a1_scan_{_name}", _name)

job("a3_batch_profile", """
SELECT count(*) AS n_rows, CAST(16 AS BIGINT) AS n_columns,
 CAST(sum((study_id IS NULL)::INT + (patient_id IS NULL)::INT + (sample_id IS NULL)::INT + (mutation_count IS NULL)::INT
  + (tmb_nonsynonymous IS NULL)::INT + (overall_survival_months IS NULL)::INT + (overall_survival_status IS NULL)::INT
  + (sex IS NULL)::INT + (diagnosis_age IS NULL)::INT + (smoker IS NULL)::INT + (smoking_history IS NULL)::INT
  + (stage_at_diagnosis IS NULL)::INT + (oncotree_code IS NULL)::INT + (t_stage IS NULL)::INT + (n_stage IS NULL)::INT
  + (m_stage IS NULL)::INT) AS BIGINT) AS missing_cells
FROM clinical_data""")(lambda w: profiling.profile(w["clinical_data"]))

columns_job("a14_export_clinical_features", "mart_risk_features_clinical", C.CLINICAL_EXPORT, order=["sample_id"])
table_job("a14_export_genomic_features", "mart_risk_features_genomic", _GENOMIC_DIGITS, ["sample_id"])
table_job("a14_export_combined_features", "mart_risk_features_combined", {"mean_expression": 9}, ["sample_id"])
table_job("a14_export_drug_sensitivity", "mart_drug_sensitivity", {"ic50_um": 15}, ["drug_name", "cell_line"])
_REC = ["sample_id", "sclc_subtype", "drug_rank", "drug_name", "recommendation_score", "recommendation_priority",
        "treatment_rationale"]
columns_job("a14_export_recommendations", "mart_treatment_recommendations", _REC, order=["sample_id", "drug_rank"])
table_job("a14_export_gene_expression", "stg_gene_expression", {"log2_expression": 9}, ["sample_id", "gene_symbol"])
table_job("a14_export_clinical_raw", "clinical_data", order=["patient_id"])
table_job("a14_export_paper_metadata", "papers", order=["pmc_id"])

# -- B: projections and filters ------------------------------------------------------------

job("b1_normalised_keys", """
SELECT upper(trim(sample_id)) AS sample_id, upper(trim(gene_symbol)) AS gene_symbol, count(*) AS n
FROM gene_expression GROUP BY ALL""")(
    lambda w: w["stg_gene_expression"].groupBy("sample_id", "gene_symbol").agg(F.count("*").alias("n")))
columns_job("b2_safe_double", "stg_experiments", ["experiment_id", "log_ic50", "hill_slope", "response_inflection"])
job("b3_safe_integer", """
SELECT nsc, CAST(round(CAST(TRY_CAST(nsc AS DOUBLE) / 8 AS DECIMAL(38,10))) AS BIGINT) AS nsc_eighth,
 CAST(round(TRY_CAST(log_ic50 AS DECIMAL(38,10))) AS BIGINT) AS log_ic50_int FROM experiments""")(
    lambda w: lookups.integer_casts(w["experiments"]))
job("b4_required_columns", """
SELECT 'clinical' AS source, count(*) AS kept FROM stg_clinical UNION ALL
SELECT 'experiments', count(*) FROM stg_experiments UNION ALL
SELECT 'dose_response', count(*) FROM stg_dose_response UNION ALL
SELECT 'gene_expression', count(*) FROM stg_gene_expression""")(
    lambda w: quality.row_counts({n: w[f"stg_{n}"] for n in (
        "clinical", "experiments", "dose_response", "gene_expression")}, "source", "kept"))
job("b5_gene_in_list", f"""
SELECT gene_symbol, sample_id, expression_value FROM stg_gene_expression
WHERE list_contains({C.BIOMARKERS}, gene_symbol)""")(
    lambda w: w["stg_gene_expression"].where(F.col("gene_symbol").isin(C.BIOMARKERS))
    .select("gene_symbol", "sample_id", "expression_value"))
job("b6_like_chains", """
SELECT DISTINCT 'gene' AS kind, gene_symbol AS hit FROM stg_gene_expression
WHERE regexp_matches(gene_symbol, '^(ASCL|NEURO|POU2|YAP|TP5|RB|MYC)')
UNION ALL SELECT DISTINCT 'sample', sample_id FROM stg_clinical WHERE regexp_matches(sample_id, '11A|12A|B08|B10|S1.*00')""")(
    lambda w: lookups.prefix_hits(w["stg_gene_expression"], w["stg_clinical"]))
job("b7_keyword_filter", """
SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 200 AND (
 contains(lower(text), 'tmb') OR contains(lower(text), 'survival') OR contains(lower(text), 'prognosis')
 OR contains(lower(text), 'treatment') OR contains(lower(text), 'outcomes') OR contains(lower(text), 'the'))""")(
    lambda w: w["documents"].where(lookups.mentions(F.col("text"), [*C.EVIDENCE_TERMS, "the"], C.EVIDENCE_MIN_CHARS))
    .select("doc_id", F.length("text").cast("bigint").alias("n")))
for _id, _table, _cols, _digits in [
    ("b8_age_group", "stg_clinical", ["sample_id", "diagnosis_age", "age_group"], {}),
    ("b9_smoking_status", "stg_clinical", ["sample_id", "smoking_status"], {}),
    ("b10_tmb_category", "stg_clinical", ["sample_id", "tmb", "tmb_category"], {}),
    ("b11_stage_group", "stg_clinical", ["sample_id", "stage_at_diagnosis", "stage_group"], {}),
    ("b12_survival_event", "stg_clinical", ["sample_id", "survival_event"], {}),
    ("b13_survival_category", "stg_clinical", ["sample_id", "overall_survival_months", "survival_category"], {}),
    ("b14_defaults", "mart_risk_features_genomic", ["sample_id", "ascl1_expression", "tp53_expression",
     "genes_expressed", "median_expression"], {"median_expression": 9}),
    ("b15_log_concentration", "stg_dose_response", ["experiment_id", "count_pct_ctrl", "log_concentration"],
     {"log_concentration": 9}),
    ("b16_variation", "stg_dose_response", ["experiment_id", "count_pct_ctrl", "coefficient_variation"],
     {"coefficient_variation": 9}),
    ("b17_quality_flag", "stg_dose_response", ["experiment_id", "count_pct_ctrl", "data_quality_flag"], {}),
    ("b18_response_category", "stg_dose_response", ["experiment_id", "count_pct_ctrl", "response_category"], {}),
    ("b19_ic50", "stg_experiments", ["experiment_id", "ic50_um"], {"ic50_um": 15}),
    ("b20_sensitivity_category", "stg_experiments", ["experiment_id", "log_ic50", "sensitivity_category"], {}),
    ("b21_log2_expression", "stg_gene_expression", ["gene_symbol", "sample_id", "log2_expression"],
     {"log2_expression": 9}),
    ("b22_expression_level", "stg_gene_expression", ["gene_symbol", "sample_id", "expression_level"], {}),
    ("b23_one_hot_flags", "mart_risk_features_clinical", ["sample_id", "is_male", "is_current_smoker",
     "is_former_smoker", "is_never_smoker", "is_tmb_high", "is_tmb_intermediate", "is_tmb_low", "is_stage_i",
     "is_stage_ii", "is_stage_iii", "is_stage_iv"], {}),
    ("b24_interactions", "mart_risk_features_clinical", ["sample_id", "age_x_advanced_stage", "smoker_x_tmb"], {}),
    ("b25_high_risk_flag", "mart_risk_features_clinical", ["sample_id", "high_risk_flag"], {}),
    ("b26_targets", "mart_risk_features_clinical", ["sample_id", "target_survival_months", "target_event",
     "target_category"], {}),
    ("b27_constant_columns", "mart_risk_features_clinical", ["sample_id", "cohort_type"], {}),
    ("b28_subtype_call", "core_biomarkers", ["sample_id", "sclc_subtype"], {}),
    ("b29_myc_family_score", "core_biomarkers", ["sample_id", "myc_family_score"], {}),
    ("b30_dual_loss", "core_biomarkers", ["sample_id", "tp53_expr", "rb1_expr", "tp53_rb1_dual_loss"], {}),
    ("b31_dominant_value", "mart_risk_features_genomic", ["sample_id", "dominant_subtype_marker_expr"], {}),
    ("b32_confidence_gap", "mart_risk_features_genomic", ["sample_id", "subtype_confidence_score"], {}),
    ("b33_target_flags", "mart_risk_features_genomic", ["sample_id", "dll3_targetable", "bcl2_targetable",
     "myc_amplified"], {}),
    ("b34_genomic_high_risk", "mart_risk_features_genomic", ["sample_id", "genomic_high_risk_flag"], {}),
    ("b35_efficacy_score", "mart_drug_sensitivity", ["experiment_id", "log_ic50", "efficacy_score"], {}),
    ("b36_response_magnitude", "mart_drug_sensitivity", ["experiment_id", "response_magnitude"], {}),
    ("b37_curve_quality_score", "mart_dose_response_summary", ["experiment_id", "curve_quality_score"], {}),
    ("b38_curve_class", "mart_dose_response_summary", ["experiment_id", "curve_quality_classification"], {}),
    ("b39_data_reliability", "mart_dose_response_summary", ["experiment_id", "data_reliability"], {}),
    ("b40_subtype_effectiveness", "mart_drug_subtype_profile", ["nsc", "drug_name", "sclc_subtype",
     "subtype_effectiveness"], {}),
    ("b41_response_consistency", "mart_drug_subtype_profile", ["nsc", "drug_name", "sclc_subtype",
     "response_consistency"], {}),
    ("b42_recommendation_score", "mart_drug_subtype_profile", ["nsc", "drug_name", "sclc_subtype",
     "recommendation_score"], {}),
    ("b43_treatment_rationale", "mart_treatment_recommendations", ["sample_id", "drug_rank", "treatment_rationale"], {}),
    ("b44_priority", "mart_treatment_recommendations", ["sample_id", "drug_rank", "recommendation_priority"], {}),
    ("b45_data_source", "mart_risk_features_combined", ["sample_id", "has_genomic_data", "data_source"], {}),
]:
    columns_job(_id, _table, _cols, _digits)

job("b11_stage_group_corrected", f"""
SELECT upper(trim(sample_id)) AS sample_id, {pick(
    "starts_with(stage_at_diagnosis, 'IV') : 'STAGE_IV'", "starts_with(stage_at_diagnosis, 'III') : 'STAGE_III'",
    "starts_with(stage_at_diagnosis, 'II') : 'STAGE_II'", "starts_with(stage_at_diagnosis, 'I') : 'STAGE_I'",
    rest="'UNKNOWN'")} AS stage_group FROM clinical_data WHERE sample_id IS NOT NULL""")(
    lambda w: staging.clinical(w["clinical_data"], corrected=True).select("sample_id", "stage_group"))
job("b25_high_risk_flag_corrected", f"""
SELECT upper(trim(sample_id)) AS sample_id, {bit("(starts_with(stage_at_diagnosis, 'III') OR starts_with(stage_at_diagnosis, 'IV'))"
  " AND coalesce(tmb_nonsynonymous, 0) < 6 AND diagnosis_age > 65")} AS high_risk_flag
FROM clinical_data WHERE sample_id IS NOT NULL AND overall_survival_months IS NOT NULL""")(
    lambda w: marts.risk_features_clinical(staging.clinical(w["clinical_data"], corrected=True))
    .select("sample_id", "high_risk_flag"))
job("b32_confidence_gap_corrected", """
SELECT sample_id, v[1] - v[2] AS subtype_confidence_score FROM (SELECT sample_id, list_reverse_sort(
 [ascl1_expression, neurod1_expression, pou2f3_expression, yap1_expression]) AS v FROM mart_risk_features_genomic)""")(
    lambda w: marts.genomic_features(w["core_biomarkers"], corrected=True)
    .select("sample_id", "subtype_confidence_score"))

_SCORE = "CAST(mutation_count AS DOUBLE) / 6"
job("b46_risk_level", f"""
SELECT sample_id, {rnd(_SCORE, 6)} AS risk_score,
 {pick(f"{_SCORE} >= 80 : 'VERY_HIGH_RISK'", f"{_SCORE} >= 60 : 'HIGH_RISK'", f"{_SCORE} >= 40 : 'MODERATE_RISK'", rest="'LOW_RISK'")} AS warehouse_level,
 {pick(f"{_SCORE} >= 70 : 'VERY_HIGH_RISK'", f"{_SCORE} >= 50 : 'HIGH_RISK'", f"{_SCORE} >= 30 : 'MODERATE_RISK'", rest="'LOW_RISK'")} AS service_level,
 {pick(f"{_SCORE} >= 70 : 'VERY_HIGH'", f"{_SCORE} >= 50 : 'HIGH'", f"{_SCORE} >= 30 : 'MODERATE'", rest="'LOW'")} AS agent_level
FROM stg_clinical""")(
    lambda w: rounded(w["stg_clinical"].select("sample_id", (F.col("mutation_count") / 6.0).alias("risk_score")).select(
        "*", *[lookups.risk_level(F.col("risk_score"), p).alias(f"{p}_level") for p in ("warehouse", "service", "agent")]),
        {"risk_score": 6}))
job("b47_serving_features", f"""
SELECT sample_id, {bit("tmb >= 20")} AS is_tmb_high, {bit("tmb >= 10 AND tmb < 20")} AS is_tmb_intermediate,
 {bit("tmb < 10")} AS is_tmb_low, CASE WHEN smoking_status = 'FORMER' THEN tmb ELSE 0 END AS smoker_x_tmb FROM stg_clinical""")(
    lambda w: lookups.serving_features(w["stg_clinical"]))
_NINE = [f"{g.lower()}_expression" for g in C.CHECK_GENES]
job("b48_serving_biomarkers", f"""
SELECT sample_id, myc_expression + mycl_expression + mycn_expression AS myc_family_sum,
 {bit("tp53_expression < 6 AND rb1_expression < 6")} AS dual_loss_serving,
 {rnd(f"list_avg([{', '.join(_NINE)}])", 9)} AS mean_nine, {rnd(f"list_stddev_pop([{', '.join(_NINE)}])", 9)} AS std_nine,
 CAST(len(list_filter([{', '.join(_NINE)}], lambda v : v > 5)) AS INT) AS genes_over_5
FROM mart_risk_features_genomic""")(
    lambda w: rounded(w["genomic_features"].select("sample_id", *M.serving_biomarkers(
        [F.col(c) for c in _NINE], F.col("tp53_expression"), F.col("rb1_expression"),
        [F.col(f"{g}_expression") for g in ("myc", "mycl", "mycn")])), {"mean_nine": 9, "std_nine": 9}))


def markers_of(suffix: str = "_expression") -> dict[str, Column]:
    return {g: F.col(f"{g.lower()}{suffix}") for g in C.SUBTYPE_MARKERS}


job("b49_marker_summary", """
SELECT sample_id, CASE WHEN v IS NULL THEN NULL WHEN ascl1_expr = v THEN 'ASCL1' WHEN neurod1_expr = v THEN 'NEUROD1'
  WHEN pou2f3_expr = v THEN 'POU2F3' ELSE 'YAP1' END AS dominant_tf, v AS dominant_value,
 (ascl1_expr + neurod1_expr) / 2 AS ne_score, (pou2f3_expr + yap1_expr) / 2 AS non_ne_score
FROM (SELECT *, CASE WHEN ascl1_expr + neurod1_expr + pou2f3_expr + yap1_expr IS NOT NULL THEN
  greatest(ascl1_expr, neurod1_expr, pou2f3_expr, yap1_expr) END AS v FROM core_biomarkers)""")(
    lambda w: w["core_biomarkers"].select("sample_id", *M.marker_summary(markers_of("_expr"))))
job("b50_factor_dominance", f"""
SELECT sample_id, CASE v WHEN a THEN 'ASCL1' WHEN n THEN 'NEUROD1' WHEN p THEN 'POU2F3' ELSE 'YAP1' END AS dominant_tf,
 v AS dominant_value, {rnd("CASE WHEN (a+n+p+y-v) / 3 > 0 THEN v / ((a+n+p+y-v) / 3) ELSE v END", 9)} AS dominance_ratio,
 CASE WHEN a + n > p + y THEN 'Neuroendocrine' ELSE 'Non-Neuroendocrine' END AS nature, a + n AS ne_sum, p + y AS non_ne_sum
FROM (SELECT sample_id, ascl1_expression a, neurod1_expression n, pou2f3_expression p, yap1_expression y,
 dominant_subtype_marker_expr v FROM mart_risk_features_genomic)""")(
    lambda w: rounded(w["genomic_features"].select("sample_id", *M.factor_dominance(markers_of())),
                      {"dominance_ratio": 9}))
job("b51_compatibility", """
SELECT sample_id,
 CAST((a > 10)::INT*40 + (a > n AND a > p AND a > y)::INT*30 + (n < 8)::INT*15 + (p < 8 AND y < 8)::INT*15 AS INT) AS fit_a,
 CAST((n > 10)::INT*40 + (n > a AND n > p AND n > y)::INT*30 + (a < 8)::INT*15 + (p < 8 AND y < 8)::INT*15 AS INT) AS fit_n,
 CAST((p > 10)::INT*40 + (p > a AND p > n AND p > y)::INT*30 + (a < 8 AND n < 8)::INT*15 + (y < 8)::INT*15 AS INT) AS fit_p,
 CAST((y > 10)::INT*40 + (y > a AND y > n AND y > p)::INT*30 + (a < 8 AND n < 8)::INT*15 + (p < 8)::INT*15 AS INT) AS fit_y
FROM (SELECT sample_id, ascl1_expression a, neurod1_expression n, pou2f3_expression p, yap1_expression y
 FROM mart_risk_features_genomic)""")(
    lambda w: w["genomic_features"].select("sample_id", *[
        points.alias(f"fit_{s[-1].lower()}") for s, points in M.compatibility(markers_of()).items()]))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


job("b52_lookup_texts", f"""
SELECT g.sample_id, t.nature, t.marker, t.therapy, coalesce(t.targets, {_quoted(C.SUBTYPE_TARGET_REST)}) AS targets
FROM (SELECT sample_id, sclc_subtype FROM core_biomarkers) g LEFT JOIN (VALUES {", ".join(
    "(" + ", ".join(_quoted(x) for x in (s, *C.SUBTYPE_THERAPY[s], C.SUBTYPE_TARGETS[s])) + ")"
    for s in C.SUBTYPES)}) t(subtype, nature, marker, therapy, targets) ON g.sclc_subtype = t.subtype""")(
    lambda w: lookups.with_subtype_texts(w["core_biomarkers"].select("sample_id", "sclc_subtype"))
    .select("sample_id", "nature", "marker", "therapy", "targets"))
job("b52_protocol_by_risk", f"""
SELECT sample_id, CASE level {" ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in C.TREATMENT_PROTOCOLS.items())}
 ELSE {_quoted(C.TREATMENT_PROTOCOL_REST)} END AS protocol
FROM (SELECT sample_id, {pick(f"{_SCORE} >= 70 : 'VERY_HIGH'", f"{_SCORE} >= 50 : 'HIGH'", f"{_SCORE} >= 30 : 'MODERATE'", rest="'LOW'")} AS level
 FROM stg_clinical)""")(
    lambda w: lookups.with_protocol(w["stg_clinical"].select(
        "sample_id", lookups.risk_level(F.col("mutation_count") / 6.0, "agent").alias("risk_level")))
    .select("sample_id", "protocol"))
job("b53_input_ranges", f"""
SELECT sample_id, {bit("age BETWEEN 0 AND 120 AND mutation_count >= 0 AND tmb >= 0 AND is_male IN (0, 1) AND is_former_smoker IN (0, 1)"
  " AND is_tmb_high IN (0, 1) AND is_tmb_intermediate IN (0, 1) AND is_tmb_low IN (0, 1)")} AS is_valid FROM mart_risk_features_clinical""")(
    lambda w: lookups.with_validity(w["mart_risk_features_clinical"]).select("sample_id", "is_valid"))
job("b53_marker_ranges", f"""
SELECT sample_id, {bit(" AND ".join(f"{g.lower()}_expr BETWEEN 0 AND 20" for g in C.CHECK_GENES))} AS is_valid FROM core_biomarkers""")(
    lambda w: w["core_biomarkers"].select("sample_id", lookups.markers_valid(
        [F.col(f"{g.lower()}_expr") for g in C.CHECK_GENES]).alias("is_valid")))
job("b54_drugs_by_line", "SELECT * REPLACE (" + replaced({"ic50_um": 15}) + ") FROM mart_drug_sensitivity WHERE cell_line = 'H69'")(
    lambda w: rounded(lookups.drugs_for(w["mart_drug_sensitivity"], cell_line="H69"), {"ic50_um": 15}))
job("b54_recommendations_by_subtype", f"SELECT {', '.join(_REC)} FROM mart_treatment_recommendations WHERE sclc_subtype = 'SCLC-N'")(
    lambda w: lookups.recommendations_for(w["mart_treatment_recommendations"], sclc_subtype="SCLC-N").select(*_REC))
job("b55_cell_line_subtype", "SELECT * FROM cell_line_subtypes")(lambda w: w["cell_line_subtypes"])
job("b56_field_formats", f"""
SELECT user_id, {bit("length(username) >= 3 AND regexp_full_match(username, '[a-zA-Z0-9_]+')")} AS username_ok,
 {bit("regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}')")} AS email_ok FROM users""")(
    lambda w: lookups.field_formats(w["users"]).select("user_id", "username_ok", "email_ok"))
job("b57_question_router", """
SELECT question_id, CASE WHEN regexp_matches(lower(question), 'feedback|rating|comment|review|sentiment|opinion') THEN 'USER_FEEDBACK'
 WHEN regexp_matches(lower(question), 'how many users|total users|count users|registered users|new accounts') THEN 'USERS'
 WHEN regexp_matches(lower(question), 'click|button|usage|feature|login|signup|event|trend|find_centers|risk|research|subtype')
 THEN 'USER_ACQUISITION_EVENTS' END AS routed_table FROM questions""")(
    lambda w: w["questions"].select("question_id", lookups.route_question(F.col("question")).alias("routed_table")))
job("b58_scoring_defaults", """
SELECT sample_id, coalesce(is_sclc_a, 0) AS is_sclc_a, coalesce(is_sclc_y, 0) AS is_sclc_y, ascl1_expression
FROM mart_risk_features_combined""")(
    lambda w: lookups.scoring_defaults(
        w["mart_risk_features_combined"].select("sample_id", "is_sclc_a", "is_sclc_y", "ascl1_expression")))
job("b59_lung_cohort", """
SELECT line_id, cell_line_name FROM sample_info WHERE lineage = 'lung' AND (contains(lower(coalesce(primary_disease, '')), 'small cell')
 OR contains(lower(coalesce(lineage_subtype, '')), 'small cell') OR contains(lower(coalesce(lineage_subtype, '')), 'sclc'))""")(
    lambda w: lookups.small_cell_lines(w["sample_info"]).select("line_id", "cell_line_name"))
job("b60_gene_lookup", f"""
SELECT g.gene, min_by(m.column_name, ((m.column_name <> g.gene)::INT, m.position)) AS column_name
FROM (SELECT unnest({C.STUDY_GENES}) AS gene) g JOIN matrix_genes m ON m.column_name = g.gene OR starts_with(m.column_name, g.gene || ' (')
GROUP BY g.gene""")(lambda w: lookups.find_genes(w["matrix_genes"], C.STUDY_GENES))
job("b60_gene_contains", f"""
SELECT g.gene, min_by(m.column_name, m.position) AS column_name
FROM (SELECT unnest({C.STUDY_GENES}) AS gene) g JOIN matrix_genes m ON contains(upper(m.column_name), g.gene) GROUP BY g.gene""")(
    lambda w: lookups.genes_containing(w["matrix_genes"], C.STUDY_GENES))

# -- C: joins ------------------------------------------------------------------------------

columns_job("c1_clinical_with_genomic", "mart_risk_features_combined", ["sample_id", "age", "tmb", "sclc_subtype",
            "myc_family_score", "has_genomic_data"])
columns_job("c2_biomarkers_with_summary", "mart_risk_features_genomic", ["sample_id", "sclc_subtype", "genes_expressed",
            "mean_expression"], {"mean_expression": 9})
columns_job("c3_experiments_with_lookups", "mart_drug_sensitivity", ["experiment_id", "nsc", "drug_name", "cas",
            "cell_line", "panel"])
columns_job("c4_doses_with_experiments", "mart_dose_response_summary", ["experiment_id", "num_dose_points", "nsc",
            "cell_line", "log_ic50"])
job("c5_sensitivity_with_subtypes", """
SELECT s.experiment_id, s.cell_line, t.inferred_subtype FROM mart_drug_sensitivity s JOIN cell_line_subtypes t
ON s.cell_line = t.cell_line""")(
    lambda w: w["mart_drug_sensitivity"].select("experiment_id", "cell_line").join(
        w["cell_line_subtypes"].select("cell_line", "inferred_subtype"), "cell_line"))
columns_job("c6_patients_with_drugs", "mart_treatment_recommendations", ["sample_id", "drug_rank", "nsc", "drug_name"])
job("c8_clinical_without_expression", """
SELECT count(DISTINCT sample_id) AS clinical_only_samples FROM stg_clinical
WHERE sample_id NOT IN (SELECT sample_id FROM stg_gene_expression)""")(
    lambda w: w["stg_clinical"].join(w["stg_gene_expression"], "sample_id", "left_anti")
    .agg(F.countDistinct("sample_id").alias("clinical_only_samples")))
job("c15_patient_profile", """
SELECT c.sample_id, c.age, c.tmb, c.target_category, g.sclc_subtype, g.ascl1_expression, g.neurod1_expression,
 g.pou2f3_expression, g.yap1_expression
FROM mart_risk_features_clinical c LEFT JOIN mart_risk_features_genomic g ON c.sample_id = g.sample_id""")(
    lambda w: lookups.patient_profiles(w["mart_risk_features_clinical"], w["genomic_features"]).select(
        "sample_id", "age", "tmb", "target_category", "sclc_subtype", "ascl1_expression", "neurod1_expression",
        "pou2f3_expression", "yap1_expression"))
job("c16_id_overlap", """
SELECT line_id, cell_line_name FROM sample_info WHERE line_id IN (SELECT sample_id FROM stg_gene_expression)""")(
    lambda w: w["sample_info"].join(
        w["stg_gene_expression"].select(F.col("sample_id").alias("line_id")), "line_id", "left_semi")
    .select("line_id", "cell_line_name"))

# -- D, E, F, G: aggregates, windows, sorts, sets --------------------------------------------

columns_job("d1_gene_pivot", "core_biomarkers", ["sample_id", *[f"{g.lower()}_expr" for g in C.BIOMARKERS]])
table_job("d2_gene_summary", "gene_summary",
          {"mean_gene_expression": 9, "stddev_gene_expression": 9, "median_gene_expression": 9})
columns_job("d3_dose_summary", "mart_dose_response_summary", ["experiment_id", "num_dose_points", "min_concentration",
            "max_concentration", "min_response", "max_response", "avg_response", "response_range", "avg_cv"],
            {"avg_response": 9, "avg_cv": 9})
columns_job("d4_conditional_counts", "mart_dose_response_summary", ["experiment_id", "low_variability_points",
            "high_variability_points", "strong_inhibition_points", "moderate_inhibition_points",
            "weak_inhibition_points", "minimal_effect_points"])
table_job("d5_drug_subtype_profile", "mart_drug_subtype_profile", _PROFILE_DIGITS)
for _id, _table, _key in [
    ("d6_target_distribution", "mart_risk_features_clinical", "target_category"),
    ("d6_subtype_distribution", "mart_risk_features_genomic", "sclc_subtype"),
    ("d6_sex_distribution", "mart_risk_features_clinical", "is_male"),
    ("e3_percent_of_total", "mart_risk_features_combined", "data_source"),
]:
    job(_id, f"""SELECT {_key}, count(*) AS sample_count, {rnd("count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()", 1)} AS percentage
FROM {_table} GROUP BY {_key}""")(
        lambda w, t=_table, k=_key: quality.distribution(w["genomic_features" if t == "mart_risk_features_genomic" else t], k))
_MARTS = {"Clinical Features": "mart_risk_features_clinical", "Genomic Features": "mart_risk_features_genomic",
          "Combined Features": "mart_risk_features_combined", "Drug Sensitivity": "mart_drug_sensitivity",
          "Drug-Subtype Profile": "mart_drug_subtype_profile",
          "Treatment Recommendations": "mart_treatment_recommendations",
          "Dose Response Summary": "mart_dose_response_summary"}


def _counts_sql(named: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS table_name, count(*) AS row_count FROM {t}" for k, t in named.items())


job("d7_mart_row_counts", _counts_sql(_MARTS))(lambda w: quality.row_counts({k: w[t] for k, t in _MARTS.items()}))
job("g1_raw_row_counts", _counts_sql({n: n for n in schemas.RAW}))(
    lambda w: quality.row_counts({n: w[n] for n in schemas.RAW}))
job("d8_sex_by_category", """
SELECT CASE WHEN is_male = 1 THEN 'Male' ELSE 'Female' END AS sex, target_category, count(*) AS n
FROM mart_risk_features_clinical GROUP BY ALL""")(
    lambda w: w["mart_risk_features_clinical"].groupBy(
        F.when(F.col("is_male") == 1, "Male").otherwise("Female").alias("sex"), "target_category")
    .agg(F.count("*").alias("n")))
job("d8_genomic_by_source", """
SELECT has_genomic_data, data_source, count(*) AS patient_count FROM mart_risk_features_combined GROUP BY ALL""")(
    lambda w: w["mart_risk_features_combined"].groupBy("has_genomic_data", "data_source")
    .agg(F.count("*").alias("patient_count")))
job("d9_gene_coverage", f"""
SELECT gene_symbol, count(DISTINCT sample_id) AS sample_count, {rnd("avg(expression_value)", 9)} AS avg_expression
FROM stg_gene_expression WHERE gene_symbol IN ('ASCL1', 'NEUROD1', 'POU2F3', 'YAP1') GROUP BY gene_symbol""")(
    lambda w: rounded(quality.gene_coverage(w["stg_gene_expression"]), {"avg_expression": 9}))
job("d10_panel_distribution", "SELECT panel, count(*) AS cell_line_count FROM cell_lines GROUP BY panel")(
    lambda w: w["cell_lines"].groupBy("panel").agg(F.count("*").alias("cell_line_count")))
job("d11_table_counts", """
SELECT (SELECT count(*) FROM mart_drug_sensitivity) AS sensitivity_rows,
 (SELECT count(*) FROM mart_dose_response_summary) AS response_rows""")(
    lambda w: w["mart_drug_sensitivity"].agg(F.count("*").alias("sensitivity_rows")).withColumn(
        "response_rows", w["mart_dose_response_summary"].agg(F.count("*")).scalar()))
job("e1_top_drugs", "SELECT * REPLACE (" + replaced({"avg_ic50_um": 15, "avg_efficacy_score": 9}) + ") FROM top_drugs")(
    lambda w: rounded(w["top_drugs"], {"avg_ic50_um": 15, "avg_efficacy_score": 9}))
job("f1_ordered_profile", "SELECT * REPLACE (" + replaced(_PROFILE_DIGITS) + ") FROM mart_drug_subtype_profile ORDER BY sclc_subtype, avg_efficacy_score DESC")(
    lambda w: rounded(w["mart_drug_subtype_profile"], _PROFILE_DIGITS)
    .orderBy("sclc_subtype", F.desc_nulls_last("avg_efficacy_score")))
job("f2_first_sample_ids", "SELECT DISTINCT sample_id FROM stg_clinical ORDER BY sample_id LIMIT 20")(
    lambda w: w["stg_clinical"].select("sample_id").distinct().orderBy("sample_id").limit(20))
job("f2_first_expression_ids", "SELECT DISTINCT sample_id FROM stg_gene_expression ORDER BY sample_id LIMIT 20")(
    lambda w: w["stg_gene_expression"].select("sample_id").distinct().orderBy("sample_id").limit(20))
job("f2_first_genomic_ids", "SELECT DISTINCT sample_id FROM mart_risk_features_genomic ORDER BY sample_id LIMIT 20")(
    lambda w: w["genomic_features"].select("sample_id").distinct().orderBy("sample_id").limit(20))
# Whole rows: no column is left out, and ties are settled by every column.
job("f3_preview_genomic", f"SELECT * REPLACE ({replaced(_GENOMIC_DIGITS)}) FROM mart_risk_features_genomic ORDER BY sample_id LIMIT 10")(
    lambda w: rounded(w["mart_risk_features_genomic"].orderBy("sample_id").limit(10), _GENOMIC_DIGITS))
_STG = ["sample_id", "gene_symbol", "expression_value", "log2_expression", "expression_level"]
job("f3_preview_expression", f"""
SELECT * REPLACE ({replaced({"log2_expression": 9})}) FROM stg_gene_expression ORDER BY {', '.join(f'{c} NULLS FIRST' for c in _STG)} LIMIT 20""")(
    lambda w: rounded(w["stg_gene_expression"].orderBy(*[F.asc_nulls_first(c) for c in _STG]).limit(20), {"log2_expression": 9}))
job("f4_top3_per_sample", f"SELECT {', '.join(_REC)} FROM mart_treatment_recommendations WHERE drug_rank <= 3 ORDER BY sample_id, drug_rank LIMIT 30")(
    lambda w: w["mart_treatment_recommendations"].where(F.col("drug_rank") <= 3).select(*_REC)
    .orderBy("sample_id", "drug_rank").limit(30))
job("g2_distinct_check_genes", f"SELECT DISTINCT gene_symbol FROM stg_gene_expression WHERE gene_symbol IN ({', '.join(repr(g) for g in C.CHECK_GENES)})")(
    lambda w: w["stg_gene_expression"].where(F.col("gene_symbol").isin(C.CHECK_GENES)).select("gene_symbol").distinct())
job("g5_id_intersection", "SELECT line_id AS sample_id FROM sample_info INTERSECT SELECT sample_id FROM stg_gene_expression")(
    lambda w: w["sample_info"].select(F.col("line_id").alias("sample_id")).intersect(
        w["stg_gene_expression"].select("sample_id")))
_CHECKED = ["stg_clinical", "stg_gene_expression", *_MARTS.values()]


def _shares(check: str, table: str, key: str) -> str:
    share = rnd("count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()", 1)
    return f"SELECT '{check}' AS check_name, CAST({key} AS VARCHAR) AS key, {share} AS value FROM {table} GROUP BY {key}"


job("q1_check_report", " UNION ALL ".join([
    *[f"SELECT 'rows' AS check_name, '{t}' AS key, CAST(count(*) AS DOUBLE) AS value FROM {t}" for t in [*_CHECKED, "cell_lines"]],
    _shares("share_by_category", "mart_risk_features_clinical", "target_category"),
    _shares("share_by_sex", "mart_risk_features_clinical", "is_male"),
    _shares("share_by_subtype", "mart_risk_features_genomic", "sclc_subtype"),
    f"""SELECT 'samples_by_gene', gene_symbol, CAST(count(DISTINCT sample_id) AS DOUBLE) FROM stg_gene_expression
WHERE list_contains({C.CHECK_GENES}, gene_symbol) GROUP BY gene_symbol""",
    """SELECT 'unmatched', 'clinical_only_samples', CAST(count(DISTINCT sample_id) AS DOUBLE) FROM stg_clinical
WHERE sample_id NOT IN (SELECT sample_id FROM stg_gene_expression)""",
    """SELECT 'repeated_cell_line', upper(trim(cell_line)), CAST(count(*) AS DOUBLE) FROM cell_lines
GROUP BY upper(trim(cell_line)) HAVING count(*) > 1"""]))(
    lambda w: quality.report({**{t: w[t] for t in _CHECKED}, "cell_lines": staging.cell_lines(w["cell_lines"])}))


def _known(check: str, table: str, column: str, values: list) -> list[str]:
    listed = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return [*[f"SELECT '{check}' AS check_name, '{v}' AS key, CAST(count(*) FILTER ({column} = {v!r}) AS DOUBLE) AS value FROM {table}" for v in values],
            f"SELECT '{check}', 'other', CAST(count(*) FILTER ({column} IS NULL OR {column} NOT IN ({listed})) AS DOUBLE) FROM {table}"]


def _formed(check: str, table: str) -> list[str]:
    good = f"coalesce(regexp_matches(sample_id, '{quality.ID_FORMAT}'), false)"
    return [f"SELECT '{check}' AS check_name, '{key}' AS key, CAST(count(*) FILTER ({test}) AS DOUBLE) AS value FROM {table}"
            for key, test in (("well_formed", good), ("other", f"NOT {good}"))]


job("q1_build_report", " UNION ALL ".join([
    *[f"SELECT 'rows' AS check_name, '{t}' AS key, CAST(count(*) AS DOUBLE) AS value FROM {t}" for t in quality.OBSERVED],
    *_known("panel", "cell_lines", "panel", [C.CELL_LINE_PANEL]),
    *_formed("clinical_id_format", "stg_clinical"), *_formed("expression_id_format", "stg_gene_expression"),
    *[f"SELECT 'samples_by_gene', '{g}', CAST(count(DISTINCT sample_id) AS DOUBLE) FROM stg_gene_expression WHERE gene_symbol = '{g}'"
      for g in C.CHECK_GENES],
    *_known("category", "mart_risk_features_clinical", "target_category", [label for _, _, label in C.SURVIVAL_BANDS]),
    *_known("is_male", "mart_risk_features_clinical", "is_male", [0, 1]),
    *_known("subtype", "mart_risk_features_genomic", "sclc_subtype", [*C.SUBTYPES, "MIXED"]),
    *_known("has_genomic_data", "mart_risk_features_combined", "has_genomic_data", [0, 1])]))(
    lambda w: build_observed(w, scratch_dir(w.spark, "marts")))
job("h_scalar_functions", f"""
SELECT c_custkey, upper(trim(' ' || c_name)) AS h1, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS h2,
 TRY_CAST(substring(c_name, 10) AS DOUBLE) AS h3, {rnd("sqrt(abs(c_acctbal)) + pow(2.0, c_nationkey / 8.0::DOUBLE)", 6)} AS h4,
 greatest(c_nationkey, 7) AS h5, (c_nationkey BETWEEN 3 AND 9 OR c_name ILIKE '%000%') AS h6, length(c_name || c_mktsegment)::INT AS h7,
 CAST(json_extract_string(json_object('k', c_nationkey), '$.k') AS INT) AS h8, make_timestamp(c_custkey * 1000000) AS h9,
 sha256(c_name) AS h12, replace(split_part(c_name, '#', 2), '0', 'o') AS h13, regexp_extract(c_name, '([0-9]+)', 1) AS h14,
 isnan(c_acctbal) OR c_acctbal IS NULL AS h17 FROM customer""")(
    lambda w: rounded(w["customer"].selectExpr(
        "c_custkey", "upper(trim(' ' || c_name)) AS h1", "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS h2",
        "try_cast(substring(c_name, 10) AS DOUBLE) AS h3", "sqrt(abs(c_acctbal)) + power(2.0D, c_nationkey / 8.0D) AS h4",
        "greatest(c_nationkey, 7) AS h5", "c_nationkey BETWEEN 3 AND 9 OR c_name ILIKE '%000%' AS h6",
        "length(c_name || c_mktsegment) AS h7", "parse_json(to_json(struct(c_nationkey AS k))):k::int AS h8",
        "timestamp_millis(c_custkey * 1000) AS h9", "sha2(c_name, 256) AS h12", "replace(split_part(c_name, '#', 2), '0', 'o') AS h13",
        "regexp_extract(c_name, '([0-9]+)', 1) AS h14", "isnan(c_acctbal) OR c_acctbal IS NULL AS h17"), {"h4": 6}))
columns_job("k20_clinical_training_extract", "mart_risk_features_clinical", C.CLINICAL_EXPORT, order=["sample_id"])
columns_job("k20_genomic_training_extract", "mart_risk_features_genomic", C.SUBTYPE_EXTRACT,
            {"mean_expression": 9, "stddev_expression": 9}, ["sample_id"])
