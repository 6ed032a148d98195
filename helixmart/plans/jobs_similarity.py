"""Jobs for similar patients, similar profiles and the composed analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmart.functions import constants as C
from helixmart.operators import similarity as S
from helixmart.plans.check_views import bit, pick, rnd
from helixmart.plans.jobs_features import rounded
from helixmart.plans.registry import CHECK_VIEWS, job

V = CHECK_VIEWS

V["similar_count"] = """
SELECT q.sample_id, count(p.sample_id) AS similar_patients_found FROM mart_risk_features_clinical q
LEFT JOIN mart_risk_features_clinical p ON abs(p.age - q.age) <= 10 AND abs(p.tmb - q.tmb) <= 5 GROUP BY q.sample_id"""
V["near_burden"] = """
SELECT q.sample_id, p.sample_id AS neighbour_id, p.age, p.tmb, p.mutation_count, p.target_survival_months,
 CAST(row_number() OVER (PARTITION BY q.sample_id ORDER BY abs(p.tmb - q.tmb), p.sample_id) AS INT) AS place
FROM mart_risk_features_clinical q JOIN mart_risk_features_clinical p
ON abs(p.age - q.age) <= 10 AND abs(p.tmb - q.tmb) <= 5 QUALIFY place <= 5"""
V["near_age_burden"] = """
SELECT q.sample_id, p.sample_id AS neighbour_id, p.age, p.tmb, p.mutation_count, p.target_survival_months, p.target_category,
 CAST(row_number() OVER (PARTITION BY q.sample_id ORDER BY abs(p.age - q.age) + abs(p.tmb - q.tmb), p.sample_id) AS INT) AS place
FROM mart_risk_features_clinical q JOIN mart_risk_features_clinical p ON abs(p.age - q.age) <= 10
 AND abs(p.tmb - q.tmb) <= 5 AND abs(p.mutation_count - q.mutation_count) <= 100 QUALIFY place <= 8"""
V["category_text"] = """
SELECT sample_id, string_agg(target_category || '=' || n, ',' ORDER BY target_category) AS categories
FROM (SELECT sample_id, target_category, count(*) AS n FROM near_age_burden WHERE target_category IS NOT NULL GROUP BY ALL)
GROUP BY sample_id"""
V["centroid"] = f"""
SELECT sclc_subtype AS query_subtype, {", ".join(f"{rnd(f'avg({c})', 6)} AS {c}" for c in S.MARKER_COLUMNS)}
FROM mart_risk_features_genomic GROUP BY sclc_subtype"""
V["profile_count"] = f"""
SELECT q.query_subtype, count(*) AS n FROM centroid q JOIN mart_risk_features_genomic g
ON {" OR ".join(f"g.{c} BETWEEN q.{c} - 2 AND q.{c} + 2" for c in S.MARKER_COLUMNS)} GROUP BY q.query_subtype"""
V["near_profile"] = f"""
SELECT q.query_subtype, g.sample_id, g.sclc_subtype,
 round(sqrt({" + ".join(f"(g.{c} - q.{c}) ** 2" for c in S.MARKER_COLUMNS)}), 9) AS distance,
 CAST(row_number() OVER (PARTITION BY q.query_subtype ORDER BY distance, g.sample_id) AS INT) AS place
FROM centroid q CROSS JOIN mart_risk_features_genomic g QUALIFY place <= 5"""
V["profile_match"] = """
SELECT query_subtype, count(*) AS n_similar, count(*) FILTER (sclc_subtype = query_subtype) AS n_matching,
 min_by(sample_id, place) AS closest_id FROM near_profile GROUP BY query_subtype"""

_SCORE = "CAST(mutation_count AS DOUBLE) / 6"


def scored(w):
    """Patients with a stand-in score, so that the parts around the model can be compared."""
    return w["mart_risk_features_clinical"].withColumn("risk_score", F.col("mutation_count") / 6.0)


def clinical(w):
    return w["mart_risk_features_clinical"]


def burden_neighbours(w):
    return S.nearest_by_burden(clinical(w), clinical(w))


job("c12_similar_patient_count", "SELECT * FROM similar_count")(lambda w: S.count_similar(clinical(w), clinical(w)))
job("c12_nearest_by_burden", "SELECT sample_id, neighbour_id, age, tmb, mutation_count, place FROM near_burden")(
    lambda w: burden_neighbours(w).select("sample_id", "neighbour_id", "age", "tmb", "mutation_count", "place"))
job("c12_nearest_by_age_and_burden",
    "SELECT sample_id, neighbour_id, age, tmb, target_category, place FROM near_age_burden")(
    lambda w: S.nearest_by_age_and_burden(clinical(w), clinical(w))
    .select("sample_id", "neighbour_id", "age", "tmb", "target_category", "place"))
job("c13_similar_profile_count", "SELECT * FROM profile_count")(
    lambda w: S.count_similar_profiles(S.subtype_centroids(w["genomic_features"]), w["genomic_features"]))
job("c14_nearest_profiles", f"SELECT query_subtype, sample_id, sclc_subtype, place, {rnd('distance', 6)} AS distance FROM near_profile")(
    lambda w: rounded(S.nearest_profiles(S.subtype_centroids(w["genomic_features"]), w["genomic_features"])
                      .select("query_subtype", "sample_id", "sclc_subtype", "place", "distance"), {"distance": 6}))
job("c14_profile_agreement", "SELECT * FROM profile_match")(
    lambda w: S.profile_agreement(S.nearest_profiles(
        S.subtype_centroids(w["genomic_features"]), w["genomic_features"])))
job("d12_cohort_summary", f"""
SELECT sample_id, count(*) AS cohort_size, {rnd("avg(age)", 6)} AS avg_age, {rnd("avg(round_even(tmb, 1))", 6)} AS avg_tmb,
 {rnd("avg(target_survival_months)", 6)} AS avg_survival, min(target_survival_months) AS min_survival,
 max(target_survival_months) AS max_survival FROM near_burden GROUP BY sample_id""")(
    lambda w: rounded(S.cohort_summary(burden_neighbours(w)), {"avg_age": 6, "avg_tmb": 6, "avg_survival": 6}))
job("d13_category_counts", "SELECT * FROM category_text")(
    lambda w: S.category_counts(S.nearest_by_age_and_burden(clinical(w), clinical(w)), "target_category")
    .select("sample_id", S.map_text("categories").alias("categories")))

_LEVEL = pick(f"{_SCORE} >= 80 : 'VERY_HIGH_RISK'", f"{_SCORE} >= 60 : 'HIGH_RISK'", f"{_SCORE} >= 40 : 'MODERATE_RISK'", rest="'LOW_RISK'")
job("i12_risk_prompt", """
SELECT sample_id, printf('Small cell lung cancer patient. Risk score %.3f of 100. Age %s. Sex %s. TMB %.3f per Mb. Mutations %d. '
 || 'Assess the risk, its drivers, treatment and outlook in a few sentences.', CAST(mutation_count AS DOUBLE) / 8,
 coalesce(CAST(age AS VARCHAR), 'unknown'), CASE is_male WHEN 1 THEN 'Male' ELSE 'Female' END, tmb, mutation_count) AS prompt
FROM mart_risk_features_clinical""")(
    lambda w: clinical(w).select("sample_id", S.risk_prompt(F.col("mutation_count") / 8.0).alias("prompt")))
job("i12_subtype_prompt", """
SELECT sample_id, printf('Subtype %s. ASCL1 %.4f, NEUROD1 %.4f, POU2F3 %.4f, YAP1 %.4f, TP53 %.4f, RB1 %.4f, MYC family %.4f. '
 || 'Report interpretation, key markers, alternatives, therapy and outlook.', sclc_subtype, ascl1_expression, neurod1_expression,
 pou2f3_expression, yap1_expression, tp53_expression, rb1_expression, myc_family_score) AS prompt
FROM mart_risk_features_genomic""")(
    lambda w: w["genomic_features"].select("sample_id", S.subtype_prompt(F.col("sclc_subtype")).alias("prompt")))
job("i12_centre_prompt", """
SELECT s_suppkey, 'List 5 cancer treatment centers near ' || s_name || ', ' || n_name
 || ' for small cell lung cancer; prefer centers suited to HIGH_RISK patients.' AS prompt
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")(
    lambda w: w["supplier"].join(w["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    .select("s_suppkey", S.centre_prompt(F.col("s_name"), F.col("n_name"), F.lit("HIGH_RISK")).alias("prompt")))
job("m3_risk_analysis", f"""
SELECT sample_id, {_LEVEL} AS risk_level, similar_patients_found,
 'Found ' || similar_patients_found || ' similar patients in database' AS message, 'full_agentic_workflow' AS analysis_type
FROM mart_risk_features_clinical JOIN similar_count USING (sample_id)""")(
    lambda w: S.risk_analysis(scored(w), clinical(w)).drop("prompt", "risk_score"))
job("m4_subtype_analysis", f"""
SELECT query_subtype, CASE v WHEN a THEN 'ASCL1' WHEN n1 THEN 'NEUROD1' WHEN p THEN 'POU2F3' ELSE 'YAP1' END AS dominant_tf,
 v AS dominant_value, {rnd("(a + n1) / 2", 9)} AS ne_score, {rnd("(p + y) / 2", 9)} AS non_ne_score, n AS samples_found,
 'Found ' || n || ' samples with similar biomarker expression patterns' AS message, 'full_subtype_analysis' AS analysis_type
FROM (SELECT *, ascl1_expression a, neurod1_expression n1, pou2f3_expression p, yap1_expression y, greatest(a, n1, p, y) AS v
 FROM centroid) JOIN profile_count USING (query_subtype)""")(
    lambda w: rounded(S.subtype_analysis(w["genomic_features"], S.subtype_centroids(w["genomic_features"])),
                      {"ne_score": 9, "non_ne_score": 9}))
job("m6_risk_flow", f"""
SELECT sample_id, level AS risk_level, CASE level {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.TREATMENT_PROTOCOLS.items())} END AS protocol,
 coalesce(n, 0) AS n_similar, {rnd("survival", 6)} AS avg_survival, categories
FROM (SELECT sample_id, {pick(f"{_SCORE} >= 70 : 'VERY_HIGH'", f"{_SCORE} >= 50 : 'HIGH'", f"{_SCORE} >= 30 : 'MODERATE'", rest="'LOW'")} AS level
  FROM mart_risk_features_clinical)
LEFT JOIN (SELECT sample_id, count(*) AS n, avg(target_survival_months) AS survival FROM near_age_burden GROUP BY ALL) USING (sample_id)
LEFT JOIN category_text USING (sample_id)""")(
    lambda w: rounded(S.risk_flow(scored(w), clinical(w)), {"avg_survival": 6}))
job("m6_subtype_flow", f"""
SELECT query_subtype, CASE v WHEN a THEN 'ASCL1' WHEN n THEN 'NEUROD1' WHEN p THEN 'POU2F3' ELSE 'YAP1' END AS dominant_tf,
 v AS dominant_value, {rnd("v / ((a + n + p + y - v) / 3)", 6)} AS dominance_ratio,
 CASE WHEN a + n > p + y THEN 'Neuroendocrine' ELSE 'Non-Neuroendocrine' END AS nature,
 {rnd("a + n", 6)} AS ne_sum, {rnd("p + y", 6)} AS non_ne_sum,
 {bit("a > 10")}*40 + {bit("v = a")}*30 + {bit("n < 8")}*15 + {bit("p < 8 AND y < 8")}*15 AS fit_a,
 {bit("n > 10")}*40 + {bit("v = n")}*30 + {bit("a < 8")}*15 + {bit("p < 8 AND y < 8")}*15 AS fit_n,
 {bit("p > 10")}*40 + {bit("v = p")}*30 + {bit("a < 8 AND n < 8")}*15 + {bit("y < 8")}*15 AS fit_p,
 {bit("y > 10")}*40 + {bit("v = y")}*30 + {bit("a < 8 AND n < 8")}*15 + {bit("p < 8")}*15 AS fit_y,
 n_similar, n_matching, closest_id
FROM (SELECT query_subtype, ascl1_expression a, neurod1_expression n, pou2f3_expression p, yap1_expression y,
 greatest(a, n, p, y) AS v FROM centroid) JOIN profile_match USING (query_subtype)""")(
    lambda w: rounded(S.subtype_flow(S.subtype_centroids(w["genomic_features"]), w["genomic_features"]),
                      {"dominance_ratio": 6, "ne_sum": 6, "non_ne_sum": 6}))

# -- every sample as its own probe -------------------------------------------------------------

V["sample_profile_count"] = f"""
SELECT q.sample_id, count(*) AS samples_found FROM mart_risk_features_genomic q JOIN mart_risk_features_genomic g
ON {" OR ".join(f"g.{c} BETWEEN q.{c} - 2 AND q.{c} + 2" for c in S.MARKER_COLUMNS)} GROUP BY q.sample_id"""
V["sample_neighbours"] = f"""
SELECT q.sample_id, q.sclc_subtype AS predicted, g.sample_id AS neighbour_id, g.sclc_subtype AS neighbour_subtype,
 round(sqrt({" + ".join(f"(g.{c} - q.{c}) ** 2" for c in S.MARKER_COLUMNS)}), 9) AS distance,
 CAST(row_number() OVER (PARTITION BY q.sample_id ORDER BY distance, g.sample_id) AS INT) AS place
FROM mart_risk_features_genomic q CROSS JOIN mart_risk_features_genomic g WHERE g.sclc_subtype <> 'MIXED' QUALIFY place <= 5"""
V["sample_agreement"] = """
SELECT sample_id, count(*) AS n_similar, count(*) FILTER (neighbour_subtype = predicted) AS n_matching,
 min_by(neighbour_id, place) AS closest_id, string_agg(neighbour_subtype, ',' ORDER BY place) AS near_subtypes
FROM sample_neighbours GROUP BY sample_id"""

job("c13_similar_profiles_of_all", "SELECT * FROM sample_profile_count")(
    lambda w: S.similar_profiles_of_all(w["genomic_features"], w["genomic_features"]).select("sample_id", "samples_found"))
job("c14_nearest_profiles_of_all",
    f"SELECT sample_id, neighbour_id, neighbour_subtype, place, {rnd('distance', 6)} AS distance FROM sample_neighbours")(
    lambda w: rounded(S.nearest_profiles_of_all(w["genomic_features"], w["genomic_features"]), {"distance": 6}))
job("c14_agreement_of_all", "SELECT * FROM sample_agreement")(
    lambda w: S.agreement_of_all(w["genomic_features"], w["genomic_features"], "sclc_subtype")
    .select("sample_id", "n_similar", "n_matching", "closest_id", "near_subtypes"))
job("m4_subtype_analysis_of_all", f"""
SELECT sample_id, sclc_subtype AS predicted_subtype,
 CASE v WHEN a THEN 'ASCL1' WHEN n1 THEN 'NEUROD1' WHEN p THEN 'POU2F3' ELSE 'YAP1' END AS dominant_tf,
 v AS dominant_value, {rnd("(a + n1) / 2", 9)} AS ne_score, {rnd("(p + y) / 2", 9)} AS non_ne_score, samples_found,
 'Found ' || samples_found || ' samples with similar biomarker expression patterns' AS message,
 printf('Subtype %s. ASCL1 %.4f, NEUROD1 %.4f, POU2F3 %.4f, YAP1 %.4f, TP53 %.4f, RB1 %.4f, MYC family %.4f. '
 || 'Report interpretation, key markers, alternatives, therapy and outlook.', sclc_subtype, a, n1, p, y, tp53_expression,
 rb1_expression, myc_family_score) AS prompt, 'full_subtype_analysis' AS analysis_type
FROM (SELECT *, ascl1_expression a, neurod1_expression n1, pou2f3_expression p, yap1_expression y, greatest(a, n1, p, y) AS v
 FROM mart_risk_features_genomic) JOIN sample_profile_count USING (sample_id)""")(
    lambda w: rounded(S.subtype_analysis_of_all(w["genomic_features"], w["genomic_features"]), {"ne_score": 9, "non_ne_score": 9}))
job("m6_subtype_flow_of_all", f"""
SELECT sample_id, sclc_subtype AS predicted_subtype,
 CASE v WHEN a THEN 'ASCL1' WHEN n THEN 'NEUROD1' WHEN p THEN 'POU2F3' ELSE 'YAP1' END AS dominant_tf,
 v AS dominant_value, {rnd("CASE WHEN a + n + p + y - v = 0 THEN v ELSE v / ((a + n + p + y - v) / 3) END", 6)} AS dominance_ratio,
 CASE WHEN a + n > p + y THEN 'Neuroendocrine' ELSE 'Non-Neuroendocrine' END AS nature,
 {rnd("a + n", 6)} AS ne_sum, {rnd("p + y", 6)} AS non_ne_sum,
 {bit("a > 10")}*40 + {bit("v = a")}*30 + {bit("n < 8")}*15 + {bit("p < 8 AND y < 8")}*15 AS fit_a,
 {bit("n > 10")}*40 + {bit("v = n")}*30 + {bit("a < 8")}*15 + {bit("p < 8 AND y < 8")}*15 AS fit_n,
 {bit("p > 10")}*40 + {bit("v = p")}*30 + {bit("a < 8 AND n < 8")}*15 + {bit("y < 8")}*15 AS fit_p,
 {bit("y > 10")}*40 + {bit("v = y")}*30 + {bit("a < 8 AND n < 8")}*15 + {bit("p < 8")}*15 AS fit_y,
 n_similar, n_matching, closest_id, near_subtypes
FROM (SELECT *, ascl1_expression a, neurod1_expression n, pou2f3_expression p, yap1_expression y, greatest(a, n, p, y) AS v
 FROM mart_risk_features_genomic) JOIN sample_agreement USING (sample_id)""")(
    lambda w: rounded(S.subtype_flow_of_all(w["genomic_features"], w["genomic_features"]),
                      {"dominance_ratio": 6, "ne_sum": 6, "non_ne_sum": 6}))
