"""Checking SQL for the staging views and marts, in the dialect of the checking engine.

Written apart from the jobs: cut points are spelled out again here, so that a slip
in the job's constants shows up as a difference.
"""

from helixmart.plans.registry import CHECK_VIEWS

GENES = "ascl1 neurod1 pou2f3 yap1 tp53 rb1 myc mycl mycn dll3 bcl2 notch1".split()


def pick(*arms: str, rest: str = "NULL") -> str:
    """CASE from 'condition : value' arms."""
    body = " ".join("WHEN {} THEN {}".format(*(part.strip() for part in arm.rsplit(":", 1))) for arm in arms)
    return f"CASE {body} ELSE {rest} END"


def bit(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def rnd(value: str, digits: int, scale: int = 12) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(38,{scale})), {digits}) AS DOUBLE)"


V = CHECK_VIEWS

V["stg_clinical"] = f"""
SELECT upper(trim(sample_id)) AS sample_id, upper(trim(patient_id)) AS patient_id, study_id, diagnosis_age, sex,
 {pick("diagnosis_age < 50 : 'YOUNG'", "diagnosis_age <= 65 : 'MIDDLE'", "diagnosis_age <= 75 : 'OLDER'",
       "diagnosis_age > 75 : 'ELDERLY'")} AS age_group,
 {pick("concat_ws('|', smoker, smoking_history) LIKE '%Current%' : 'CURRENT'",
       "concat_ws('|', smoker, smoking_history) LIKE '%Former%' : 'FORMER'",
       "concat_ws('|', smoker, smoking_history) LIKE '%Never%' : 'NEVER'", rest="'UNKNOWN'")} AS smoking_status,
 coalesce(mutation_count, 0) AS mutation_count, coalesce(tmb_nonsynonymous, 0) AS tmb,
 {pick("tmb_nonsynonymous < 6 : 'TMB_LOW'", "tmb_nonsynonymous <= 20 : 'TMB_INTERMEDIATE'",
       "tmb_nonsynonymous > 20 : 'TMB_HIGH'", rest="'UNKNOWN'")} AS tmb_category,
 stage_at_diagnosis,
 {pick("starts_with(stage_at_diagnosis, 'I') : 'STAGE_I'", rest="'UNKNOWN'")} AS stage_group,
 overall_survival_months,
 {pick("contains(overall_survival_status, 'DECEASED') : 1", "contains(overall_survival_status, 'LIVING') : 0")}
 AS survival_event,
 {pick("overall_survival_months < 12 : 'SHORT'", "overall_survival_months <= 36 : 'MEDIUM'",
       "overall_survival_months > 36 : 'LONG'")} AS survival_category
FROM clinical_data WHERE sample_id IS NOT NULL"""

V["stg_gene_expression"] = f"""
SELECT upper(trim(gene_symbol)) AS gene_symbol, upper(trim(sample_id)) AS sample_id, expression_value,
 CASE WHEN expression_value > 0 THEN log2(expression_value) END AS log2_expression,
 {pick("expression_value = 0 : 'NONE'", "expression_value > 0 AND expression_value < 1 : 'LOW'",
       "expression_value >= 1 AND expression_value <= 10 : 'MEDIUM'", "expression_value > 10 : 'HIGH'")}
 AS expression_level
FROM gene_expression
WHERE expression_value IS NOT NULL AND gene_symbol IS NOT NULL AND sample_id IS NOT NULL"""

V["stg_experiments"] = f"""
SELECT CAST(TRY_CAST(experiment_id AS DECIMAL(38,10)) AS BIGINT) AS experiment_id,
 CAST(TRY_CAST(nsc AS DECIMAL(38,10)) AS BIGINT) AS nsc, upper(trim(cell_line)) AS cell_line,
 TRY_CAST(highest_tested_concentration AS DOUBLE) AS highest_tested_concentration,
 TRY_CAST(log_ec50 AS DOUBLE) AS log_ec50, TRY_CAST(response_zero AS DOUBLE) AS response_zero,
 TRY_CAST(response_inflection AS DOUBLE) AS response_inflection, TRY_CAST(hill_slope AS DOUBLE) AS hill_slope,
 TRY_CAST(e.log_ic50 AS DOUBLE) AS log_ic50, trim(flag_ic50) AS flag_ic50,
 pow(10.0, TRY_CAST(e.log_ic50 AS DOUBLE)) AS ic50_um,
 {pick("TRY_CAST(e.log_ic50 AS DOUBLE) < -6 : 'HIGHLY_SENSITIVE'", "TRY_CAST(e.log_ic50 AS DOUBLE) <= -5 : 'SENSITIVE'",
       "TRY_CAST(e.log_ic50 AS DOUBLE) <= -4 : 'MODERATELY_RESISTANT'",
       "TRY_CAST(e.log_ic50 AS DOUBLE) > -4 : 'RESISTANT'", rest="'UNKNOWN'")} AS sensitivity_category
FROM experiments e WHERE experiment_id IS NOT NULL AND nsc IS NOT NULL AND cell_line IS NOT NULL"""

V["stg_dose_response"] = f"""
SELECT experiment_id, concentration, mean_pct_ctrl, stddev_pct_ctrl, count_pct_ctrl,
 CASE WHEN concentration > 0 THEN log10(concentration) END AS log_concentration,
 CASE WHEN mean_pct_ctrl <> 0 THEN abs(stddev_pct_ctrl / mean_pct_ctrl) * 100 END AS coefficient_variation,
 {pick("stddev_pct_ctrl IS NULL : 'NO_STDDEV'", "mean_pct_ctrl = 0 : 'LOW_VARIABILITY'",
       "abs(stddev_pct_ctrl / mean_pct_ctrl) * 100 > 30 : 'HIGH_VARIABILITY'",
       "abs(stddev_pct_ctrl / mean_pct_ctrl) * 100 > 15 : 'MODERATE_VARIABILITY'", rest="'LOW_VARIABILITY'")}
 AS data_quality_flag,
 {pick("mean_pct_ctrl < 20 : 'STRONG_INHIBITION'", "mean_pct_ctrl <= 50 : 'MODERATE_INHIBITION'",
       "mean_pct_ctrl <= 80 : 'WEAK_INHIBITION'", "mean_pct_ctrl > 80 : 'MINIMAL_EFFECT'", rest="'UNKNOWN'")}
 AS response_category
FROM dose_response
WHERE experiment_id IS NOT NULL AND concentration IS NOT NULL AND mean_pct_ctrl IS NOT NULL"""

_pivot = ", ".join(f"max(expression_value) FILTER (gene_symbol = '{g.upper()}') AS {g}_expr" for g in GENES)
V["core_biomarkers"] = f"""
SELECT *, CASE WHEN length(leaders) = 1 THEN 'SCLC-' || leaders ELSE 'MIXED' END AS sclc_subtype,
 list_max([coalesce(myc_expr, 0), coalesce(mycl_expr, 0), coalesce(mycn_expr, 0)]) AS myc_family_score,
 {bit("coalesce(tp53_expr, 0) < 5 AND coalesce(rb1_expr, 0) < 5")} AS tp53_rb1_dual_loss
FROM (SELECT *,
  CASE WHEN coalesce(ascl1_expr, 0) = top THEN 'A' ELSE '' END || CASE WHEN coalesce(neurod1_expr, 0) = top THEN 'N' ELSE '' END
  || CASE WHEN coalesce(pou2f3_expr, 0) = top THEN 'P' ELSE '' END || CASE WHEN coalesce(yap1_expr, 0) = top THEN 'Y' ELSE '' END
  AS leaders
 FROM (SELECT *, list_max([coalesce(ascl1_expr, 0), coalesce(neurod1_expr, 0), coalesce(pou2f3_expr, 0),
   coalesce(yap1_expr, 0)]) AS top
  FROM (SELECT sample_id, {_pivot} FROM stg_gene_expression
   WHERE gene_symbol IN ({", ".join(f"'{g.upper()}'" for g in GENES)}) GROUP BY sample_id)))"""

V["gene_summary"] = """
SELECT sample_id, count(DISTINCT gene_symbol) AS total_genes_expressed, avg(expression_value) AS mean_gene_expression,
 stddev_samp(expression_value) AS stddev_gene_expression, quantile_cont(expression_value, 0.5) AS median_gene_expression
FROM stg_gene_expression GROUP BY sample_id"""

V["mart_risk_features_clinical"] = f"""
SELECT sample_id, patient_id, study_id, overall_survival_months AS target_survival_months,
 survival_event AS target_event, survival_category AS target_category, diagnosis_age AS age, age_group,
 {bit("sex = 'Male'")} AS is_male, smoking_status, {bit("smoking_status = 'CURRENT'")} AS is_current_smoker,
 {bit("smoking_status = 'FORMER'")} AS is_former_smoker, {bit("smoking_status = 'NEVER'")} AS is_never_smoker,
 mutation_count, tmb, tmb_category, {bit("tmb_category = 'TMB_HIGH'")} AS is_tmb_high,
 {bit("tmb_category = 'TMB_INTERMEDIATE'")} AS is_tmb_intermediate, {bit("tmb_category = 'TMB_LOW'")} AS is_tmb_low,
 stage_group, stage_at_diagnosis, {bit("stage_group = 'STAGE_I'")} AS is_stage_i,
 {bit("stage_group = 'STAGE_II'")} AS is_stage_ii, {bit("stage_group = 'STAGE_III'")} AS is_stage_iii,
 {bit("stage_group = 'STAGE_IV'")} AS is_stage_iv, {bit("stage_group IN ('STAGE_III', 'STAGE_IV')")} AS is_advanced_stage,
 diagnosis_age * ({bit("stage_group IN ('STAGE_III', 'STAGE_IV')")}) AS age_x_advanced_stage,
 ({bit("smoking_status = 'CURRENT'")}) * tmb AS smoker_x_tmb,
 {bit("stage_group IN ('STAGE_III', 'STAGE_IV') AND tmb < 6 AND diagnosis_age > 65")} AS high_risk_flag,
 'CLINICAL_COHORT' AS cohort_type
FROM stg_clinical WHERE overall_survival_months IS NOT NULL"""

_expr = ", ".join(f"coalesce({g}_expr, 0) AS {g}_expression" for g in GENES)
V["mart_risk_features_genomic"] = f"""
SELECT b.sample_id, sclc_subtype, {bit("sclc_subtype = 'SCLC-A'")} AS is_sclc_a, {bit("sclc_subtype = 'SCLC-N'")} AS is_sclc_n,
 {bit("sclc_subtype = 'SCLC-P'")} AS is_sclc_p, {bit("sclc_subtype = 'SCLC-Y'")} AS is_sclc_y, {_expr},
 myc_family_score, tp53_rb1_dual_loss, top AS dominant_subtype_marker_expr,
 CASE WHEN contains(leaders, 'A') THEN top - list_max([coalesce(neurod1_expr, 0), coalesce(pou2f3_expr, 0),
  coalesce(yap1_expr, 0)]) ELSE top END AS subtype_confidence_score,
 {bit("dll3_expr >= 5")} AS dll3_targetable, {bit("bcl2_expr >= 5")} AS bcl2_targetable,
 {bit("myc_family_score >= 10")} AS myc_amplified, coalesce(total_genes_expressed, 0) AS genes_expressed,
 coalesce(mean_gene_expression, 0) AS mean_expression, coalesce(stddev_gene_expression, 0) AS stddev_expression,
 coalesce(median_gene_expression, 0) AS median_expression,
 {bit("tp53_rb1_dual_loss = 1 AND myc_family_score > 10")} AS genomic_high_risk_flag, 'GENOMIC_COHORT' AS cohort_type
FROM core_biomarkers b LEFT JOIN gene_summary s ON b.sample_id = s.sample_id WHERE sclc_subtype <> 'MIXED'"""

_left = [
    "patient_id", "study_id", "target_survival_months", "target_event", "target_category", "age", "age_group",
    "is_male", "smoking_status", "is_current_smoker", "is_former_smoker", "is_never_smoker", "mutation_count", "tmb",
    "tmb_category", "is_tmb_high", "is_tmb_intermediate", "is_tmb_low", "stage_group", "is_advanced_stage",
    "age_x_advanced_stage", "smoker_x_tmb", "high_risk_flag",
]
_right = [
    "sclc_subtype", "is_sclc_a", "is_sclc_n", "is_sclc_p", "is_sclc_y", "ascl1_expression", "neurod1_expression",
    "pou2f3_expression", "yap1_expression", "tp53_expression", "rb1_expression", "myc_family_score",
    "tp53_rb1_dual_loss", "dll3_targetable", "bcl2_targetable", "myc_amplified", "mean_expression",
    "genomic_high_risk_flag",
]
V["mart_risk_features_combined"] = f"""
SELECT c.sample_id, {", ".join("c." + n for n in _left)}, {", ".join("g." + n for n in _right)},
 {bit("g.sample_id IS NOT NULL")} AS has_genomic_data,
 CASE WHEN g.sample_id IS NULL THEN 'CLINICAL_ONLY' ELSE 'CLINICAL_AND_GENOMIC' END AS data_source
FROM mart_risk_features_clinical c LEFT JOIN mart_risk_features_genomic g ON c.sample_id = g.sample_id"""

V["mart_drug_sensitivity"] = f"""
SELECT e.experiment_id, e.nsc, c.drug_name, c.cas, e.cell_line, l.panel, e.ic50_um, e.log_ic50, e.log_ec50,
 e.sensitivity_category, e.hill_slope, e.response_zero, e.response_inflection,
 {pick("e.log_ic50 < -6 : 100", "e.log_ic50 < -5 : 80", "e.log_ic50 < -4 : 60", "e.log_ic50 < -3 : 40", rest="20")}
 AS efficacy_score, abs(e.response_inflection - e.response_zero) AS response_magnitude
FROM stg_experiments e
LEFT JOIN (SELECT CAST(TRY_CAST(nsc AS DECIMAL(38,10)) AS BIGINT) AS nsc, trim(cas) AS cas, trim(drug_name) AS drug_name
  FROM compounds) c ON e.nsc = c.nsc
LEFT JOIN (SELECT upper(trim(cell_line)) AS cell_line, trim(panel) AS panel FROM cell_lines) l ON e.cell_line = l.cell_line
WHERE e.ic50_um IS NOT NULL"""

V["cell_line_subtypes"] = f"""
SELECT upper(trim(cell_line)) AS cell_line, trim(panel) AS panel,
 {pick("c.cell_line IN ('H69','H82','H187','DMS273','H209','DMS-273','DMS 273') : 'SCLC-A'",
       "c.cell_line IN ('H1048','H1963','H2171') : 'SCLC-N'", "c.cell_line IN ('H1339','H1450') : 'SCLC-P'",
       "c.cell_line IN ('H446','H1672') : 'SCLC-Y'", rest="'UNKNOWN'")} AS inferred_subtype
FROM cell_lines c WHERE c.panel = 'Small Cell Lung Cancer'"""

_cats = ", ".join(
    f"count(*) FILTER (sensitivity_category = '{c}') AS {n}_count" for c, n in [
        ("HIGHLY_SENSITIVE", "highly_sensitive"), ("SENSITIVE", "sensitive"),
        ("MODERATELY_RESISTANT", "moderate_resistant"), ("RESISTANT", "resistant")])
V["mart_drug_subtype_profile"] = f"""
SELECT *, {pick("highly_sensitive_count * 2 >= num_cell_lines_tested : 'HIGHLY_EFFECTIVE'",
  "(highly_sensitive_count + sensitive_count) * 2 >= num_cell_lines_tested : 'EFFECTIVE'",
  "moderate_resistant_count * 2 >= num_cell_lines_tested : 'MODERATELY_EFFECTIVE'",
  rest="'LOW_EFFECTIVENESS'")} AS subtype_effectiveness,
 {pick("round(max_ic50_um - min_ic50_um, 12) < 0.00001 : 'HIGHLY_CONSISTENT'",
  "round(max_ic50_um - min_ic50_um, 12) < 0.0001 : 'CONSISTENT'", rest="'VARIABLE'")} AS response_consistency,
 {rnd("avg_efficacy_score * CAST(0.6 AS DOUBLE) + avg_response_magnitude * CAST(0.4 AS DOUBLE)", 2)} AS recommendation_score
FROM (SELECT s.nsc, s.drug_name, t.inferred_subtype AS sclc_subtype, count(DISTINCT s.cell_line) AS num_cell_lines_tested,
  avg(s.ic50_um) AS avg_ic50_um, avg(s.log_ic50) AS avg_log_ic50, min(s.ic50_um) AS min_ic50_um,
  max(s.ic50_um) AS max_ic50_um, avg(s.efficacy_score) AS avg_efficacy_score,
  avg(s.response_magnitude) AS avg_response_magnitude, {_cats}
 FROM mart_drug_sensitivity s JOIN cell_line_subtypes t ON s.cell_line = t.cell_line
 WHERE t.inferred_subtype <> 'UNKNOWN' GROUP BY ALL)"""

V["top_drugs"] = """
SELECT sclc_subtype, nsc, drug_name, avg_ic50_um, avg_efficacy_score, subtype_effectiveness, recommendation_score,
 num_cell_lines_tested, CAST(row_number() OVER (PARTITION BY sclc_subtype ORDER BY recommendation_score DESC NULLS FIRST,
  avg_efficacy_score DESC NULLS FIRST, nsc NULLS LAST, drug_name NULLS LAST) AS INT) AS drug_rank
FROM mart_drug_subtype_profile WHERE subtype_effectiveness IN ('HIGHLY_EFFECTIVE', 'EFFECTIVE')
QUALIFY drug_rank <= 10"""

V["mart_treatment_recommendations"] = f"""
SELECT g.sample_id, g.sclc_subtype, g.cohort_type, g.ascl1_expression, g.neurod1_expression, g.pou2f3_expression,
 g.yap1_expression, g.myc_family_score, g.tp53_rb1_dual_loss, g.dll3_targetable, g.bcl2_targetable, g.myc_amplified,
 g.genomic_high_risk_flag, d.drug_rank, d.nsc, d.drug_name, d.avg_ic50_um, d.avg_efficacy_score,
 d.subtype_effectiveness, d.recommendation_score, d.num_cell_lines_tested,
 {pick("g.dll3_targetable = 1 AND contains(d.drug_name, 'Rovalpituzumab') : 'DLL3-targeted therapy recommended'",
   "g.bcl2_targetable = 1 AND contains(d.drug_name, 'Venetoclax') : 'BCL2 inhibitor therapy recommended'",
   "g.myc_amplified = 1 : 'MYC amplification detected - consider targeted therapy'",
   "g.genomic_high_risk_flag = 1 : 'High genomic risk - aggressive treatment recommended'",
   rest="'Standard subtype-based treatment'")} AS treatment_rationale,
 {pick("d.drug_rank <= 3 AND d.recommendation_score >= 70 : 'HIGH_PRIORITY'",
   "d.drug_rank <= 5 AND d.recommendation_score >= 60 : 'MEDIUM_PRIORITY'", rest="'CONSIDER'")} AS recommendation_priority
FROM mart_risk_features_genomic g JOIN top_drugs d ON g.sclc_subtype = d.sclc_subtype"""

_curve = "CAST({}_variability_points AS DOUBLE) / num_dose_points"
V["mart_dose_response_summary"] = f"""
SELECT q.*, e.nsc, e.cell_line, e.ic50_um, e.log_ic50, e.sensitivity_category,
 {rnd(f"{_curve.format('low')} * 40 + (CASE WHEN response_range > 50 THEN 30 ELSE response_range * CAST(0.6 AS DOUBLE) END)"
      " + (CASE WHEN num_dose_points >= 8 THEN 30 WHEN num_dose_points >= 5 THEN 20 ELSE 10 END)", 2)} AS curve_quality_score,
 {pick(f"{_curve.format('high')} > CAST(0.3 AS DOUBLE) : 'POOR_QUALITY'", "response_range < 30 : 'LOW_DYNAMIC_RANGE'",
   "num_dose_points < 5 : 'INSUFFICIENT_POINTS'",
   f"{_curve.format('low')} > CAST(0.7 AS DOUBLE) AND response_range > 50 : 'HIGH_QUALITY'", rest="'ACCEPTABLE_QUALITY'")}
 AS curve_quality_classification,
 {pick(f"{_curve.format('high')} > CAST(0.3 AS DOUBLE) : 'USE_WITH_CAUTION'", "response_range < 30 : 'VERIFY_ACTIVITY'",
   rest="'RELIABLE'")} AS data_reliability
FROM (SELECT experiment_id, count(*) AS num_dose_points, min(concentration) AS min_concentration,
  max(concentration) AS max_concentration, min(mean_pct_ctrl) AS min_response, max(mean_pct_ctrl) AS max_response,
  avg(mean_pct_ctrl) AS avg_response, avg(coefficient_variation) AS avg_cv,
  count(*) FILTER (data_quality_flag = 'LOW_VARIABILITY') AS low_variability_points,
  count(*) FILTER (data_quality_flag = 'HIGH_VARIABILITY') AS high_variability_points,
  count(*) FILTER (response_category = 'STRONG_INHIBITION') AS strong_inhibition_points,
  count(*) FILTER (response_category = 'MODERATE_INHIBITION') AS moderate_inhibition_points,
  count(*) FILTER (response_category = 'WEAK_INHIBITION') AS weak_inhibition_points,
  count(*) FILTER (response_category = 'MINIMAL_EFFECT') AS minimal_effect_points,
  max(mean_pct_ctrl) - min(mean_pct_ctrl) AS response_range
 FROM stg_dose_response GROUP BY experiment_id) q LEFT JOIN stg_experiments e ON q.experiment_id = e.experiment_id"""
