"""Jobs for expression statistics, subtype labels, risk targets and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmart.functions import constants as C
from helixmart.operators import lookups, profiling, stats as S
from helixmart.plans.check_views import pick, rnd
from helixmart.plans.jobs_features import replaced, rounded
from helixmart.plans.registry import CHECK_VIEWS, job

V = CHECK_VIEWS

V["matrix"] = "SELECT gene_symbol, sample_id, max(expression_value) AS value FROM stg_gene_expression GROUP BY ALL"
V["grouped_matrix"] = """
SELECT *, CASE WHEN CAST(substring(sample_id, 2) AS INT) < CASE WHEN n >= 80 THEN 79 ELSE floor(n * 0.9) END THEN 'tumor' ELSE 'normal' END
 AS sample_group FROM matrix, (SELECT count(DISTINCT sample_id) AS n FROM matrix)"""
V["fold"] = """
SELECT gene_symbol, avg(value) FILTER (sample_group = 'tumor') AS tumor_mean, avg(value) FILTER (sample_group = 'normal') AS normal_mean,
 tumor_mean - normal_mean AS fold_change FROM grouped_matrix GROUP BY gene_symbol"""
V["variances"] = "SELECT gene_symbol, var_samp(value) AS variance FROM matrix GROUP BY gene_symbol"
V["marker_values"] = """
SELECT sample_id, coalesce(ascl1_expr, 0) AS ascl1, coalesce(neurod1_expr, 0) AS neurod1, coalesce(yap1_expr, 0) AS yap1,
 coalesce(pou2f3_expr, 0) AS pou2f3 FROM core_biomarkers"""
_M = ["ascl1", "neurod1", "yap1", "pou2f3"]
V["z_values"] = f"""
SELECT m.*, {", ".join(f"(m.{c} - s.m_{c}) / CASE WHEN s.s_{c} = 0 THEN 1e-6 ELSE s.s_{c} END AS z_{c}" for c in _M)}
FROM marker_values m, (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _M)} FROM marker_values) s"""
_PLACE = "CASE {v} WHEN {a} THEN 'SCLC-A' WHEN {n} THEN 'SCLC-N' WHEN {y} THEN 'SCLC-Y' ELSE 'SCLC-P' END"
V["labels_by_rule"] = f"""
SELECT *, {_PLACE.format(v="greatest(ascl1, neurod1, yap1, pou2f3)", a="ascl1", n="neurod1", y="yap1")} AS max_label,
 {pick("z_pou2f3 > 1 AND pou2f3 >= greatest(ascl1, neurod1, yap1) + 0.35::DOUBLE : 'SCLC-P'",
       "z_neurod1 > 1 AND z_ascl1 <= 0.5 AND neurod1 >= greatest(ascl1, pou2f3, yap1) + 0.35::DOUBLE : 'SCLC-N'",
       "z_ascl1 > 1 AND z_neurod1 <= 0.5 AND ascl1 >= greatest(neurod1, pou2f3, yap1) + 0.35::DOUBLE : 'SCLC-A'",
       "z_ascl1 + z_neurod1 < 0 AND z_yap1 > 0.3 : 'SCLC-Y'").replace("ELSE NULL END", "ELSE "
       + _PLACE.format(v="greatest(z_ascl1, z_neurod1, z_yap1, z_pou2f3)", a="z_ascl1", n="z_neurod1", y="z_yap1") + " END")} AS z_label
FROM z_values"""
V["cuts"] = """
SELECT quantile_cont(tmb, 0.5) AS tmb_median, quantile_cont(tmb, 0.75) AS tmb_q75, quantile_cont(mutation_count, 0.5) AS mutation_median,
 quantile_cont(mutation_count, 0.75) AS mutation_q75 FROM mart_risk_features_clinical"""
V["targets"] = """
SELECT c.*, (tmb > tmb_median OR mutation_count > mutation_median OR is_advanced_stage = 1)::INT AS biological_high_risk,
 coalesce((target_category = 'SHORT')::INT, 0) AS survival_high_risk,
 (tmb > tmb_q75 OR mutation_count > mutation_q75 OR (target_category = 'SHORT' AND tmb > tmb_median))::INT AS binary_risk
FROM mart_risk_features_clinical c, cuts"""


def matrix(w):
    return S.as_matrix(w["stg_gene_expression"])


def grouped(w):
    return S.sample_groups(matrix(w), F.substring("sample_id", 2, 20).cast("int"))


def labels(w):
    return S.labelled(w["core_biomarkers"])


def targets(w):
    return S.risk_targets(w["mart_risk_features_clinical"])


_Q = {n: 6 for n in ("completeness", "mean_of_sample_means", "min_sample_mean", "max_sample_mean", "min_gene_mean", "max_gene_mean")}
job("d16_matrix_quality", f"""
SELECT n_genes, n_samples, n_genes * n_samples AS n_cells, n_genes * n_samples - n AS missing_cells,
 {rnd("n * 100.0::DOUBLE / (n_genes * n_samples)", 6)} AS completeness, min_value, max_value,
 {rnd("s.mid", 6)} AS mean_of_sample_means, {rnd("s.low", 6)} AS min_sample_mean, {rnd("s.high", 6)} AS max_sample_mean,
 {rnd("g.low", 6)} AS min_gene_mean, {rnd("g.high", 6)} AS max_gene_mean
FROM (SELECT count(DISTINCT gene_symbol) AS n_genes, count(DISTINCT sample_id) AS n_samples, count(value) AS n, min(value) AS min_value,
 max(value) AS max_value FROM matrix),
 (SELECT avg(m) AS mid, min(m) AS low, max(m) AS high FROM (SELECT avg(value) AS m FROM matrix GROUP BY sample_id)) s,
 (SELECT min(m) AS low, max(m) AS high FROM (SELECT avg(value) AS m FROM matrix GROUP BY gene_symbol)) g""")(
    lambda w: rounded(S.matrix_quality(matrix(w)), _Q))
job("d17_gene_variance", f"SELECT gene_symbol, {rnd('variance', 6)} AS variance FROM variances")(
    lambda w: rounded(S.gene_variance(matrix(w)), {"variance": 6}))
job("f7_top_variable_genes", f"SELECT gene_symbol, {rnd('variance', 6)} AS variance FROM variances ORDER BY variance DESC NULLS LAST, gene_symbol LIMIT 20")(
    lambda w: rounded(S.top_variable_genes(matrix(w)), {"variance": 6}))
_FOLD = {"tumor_mean": 6, "normal_mean": 6, "fold_change": 6}
_DIRECTION = """CASE WHEN fold_change > 1 THEN 'UP' WHEN fold_change < -1 THEN 'DOWN' END AS regulated,
 CASE WHEN fold_change > 0.5 THEN 'UP' WHEN fold_change < -0.5 THEN 'DOWN' ELSE 'SIMILAR' END AS direction"""
job("d18_fold_change", f"SELECT * REPLACE ({replaced(_FOLD)}), {_DIRECTION} FROM fold")(
    lambda w: rounded(S.fold_changes(grouped(w)), _FOLD))
job("d19_sample_groups", "SELECT DISTINCT sample_id, sample_group FROM grouped_matrix")(
    lambda w: grouped(w).select("sample_id", "sample_group").distinct())
job("f6_extreme_changes", f"""
SELECT * REPLACE ({replaced(_FOLD)}) FROM (
 (SELECT *, 'UP' AS regulated FROM fold WHERE fold_change > 0.05 ORDER BY fold_change DESC, gene_symbol LIMIT 5) UNION ALL
 (SELECT *, 'DOWN' AS regulated FROM fold WHERE fold_change < -0.05 ORDER BY fold_change, gene_symbol LIMIT 5))""")(
    lambda w: rounded(S.extreme_changes(S.fold_changes(grouped(w)).drop("direction", "regulated"), cut=0.05), _FOLD))
for _id, _table, _col, _bins in [("d15_expression_histogram", "stg_gene_expression", "expression_value", 50),
                                 ("d15_burden_histogram", "mart_risk_features_clinical", "tmb", 20)]:
    job(_id, f"""
SELECT CAST(least(floor(({_col} - low) / w), {_bins - 1}) AS INT) AS bin, {rnd(f"low + least(floor(({_col} - low) / w), {_bins - 1}) * w", 6)} AS lower_edge,
 count(*) AS n FROM {_table}, (SELECT min({_col}) AS low, (max({_col}) - min({_col})) / {_bins} AS w FROM {_table}) GROUP BY ALL""")(
        lambda w, t=_table, c=_col, b=_bins: rounded(S.histogram(w[t], c, b), {"lower_edge": 6}))
_STATS = {"mean": 6, "std": 6}
job("d21_marker_statistics", " UNION ALL ".join(
    f"SELECT '{c}' AS marker, {rnd(f'avg({c})', 6)} AS mean, {rnd(f'stddev_samp({c})', 6)} AS std, min({c}) AS min, max({c}) AS max FROM marker_values"
    for c in _M))(lambda w: rounded(S.describe(S.marker_matrix(w["core_biomarkers"]), S.MARKERS), _STATS))
job("k14_max_marker_label", "SELECT sample_id, max_label FROM labels_by_rule")(lambda w: labels(w).select("sample_id", "max_label"))
_Z = {f"z_{c}": 6 for c in _M}
job("k15_z_scores", f"SELECT sample_id, {', '.join(rnd(c, 6) + f' AS {c}' for c in _Z)} FROM z_values")(
    lambda w: rounded(S.z_scores(S.marker_matrix(w["core_biomarkers"]), S.MARKERS).select("sample_id", *_Z), _Z))
job("k16_z_rule_label", "SELECT sample_id, z_label FROM labels_by_rule")(lambda w: labels(w).select("sample_id", "z_label"))
job("d20_mean_by_subtype", f"""
SELECT CAST(o.i - 1 AS INT) AS place, o.s AS z_label, {", ".join(f"{rnd(f'avg({c})', 6)} AS {c}" for c in _M)}
FROM (SELECT unnest(range(1, 5)) AS i, unnest({C.SUBTYPES}) AS s) o LEFT JOIN labels_by_rule l ON l.z_label = o.s GROUP BY o.i, o.s""")(
    lambda w: rounded(S.means_by_label(labels(w), "z_label", _M), {c: 6 for c in _M}))
job("d22_label_comparison", """
SELECT coalesce(a.l, b.l) AS label, coalesce(a.n, 0) AS n_first, coalesce(b.n, 0) AS n_second
FROM (SELECT max_label AS l, count(*) AS n FROM labels_by_rule GROUP BY 1) a
FULL JOIN (SELECT z_label AS l, count(*) AS n FROM labels_by_rule GROUP BY 1) b ON a.l = b.l""")(
    lambda w: S.label_comparison(labels(w), "max_label", "z_label"))
_ZZ = "1.96::DOUBLE"
_MARGIN = f"{_ZZ} * sqrt((p * (1 - p) + {_ZZ} * {_ZZ} / (4 * t)) / t)"
job("d23_wilson_proportions", f"""
SELECT subtype, n, {rnd("p", 3)} AS proportion, {rnd(f"greatest((p + {_ZZ} * {_ZZ} / (2 * t) - {_MARGIN}) / (1 + {_ZZ} * {_ZZ} / t), 0)", 3)} AS ci_low,
 {rnd(f"least((p + {_ZZ} * {_ZZ} / (2 * t) + {_MARGIN}) / (1 + {_ZZ} * {_ZZ} / t), 1)", 3)} AS ci_high, {rnd("p * 100", 1)} AS percent
FROM (SELECT o.s AS subtype, count(l.z_label) AS n, CAST(sum(count(l.z_label)) OVER () AS DOUBLE) AS t, n / t AS p
 FROM (SELECT unnest({C.SUBTYPES}) AS s) o LEFT JOIN labels_by_rule l ON l.z_label = o.s GROUP BY o.s)""")(
    lambda w: S.proportions(labels(w), "z_label"))
V["anova_groups"] = """
SELECT gene, z_label, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM (UNPIVOT (SELECT z_label, ascl1, neurod1, yap1, pou2f3 FROM labels_by_rule)
 ON ascl1, neurod1, yap1, pou2f3 INTO NAME gene VALUE v) GROUP BY gene, z_label HAVING count(*) >= 3"""
job("d24_anova", f"""
SELECT gene, CAST(count(*) - 1 AS DOUBLE) AS df1, CAST(sum(n) - count(*) AS DOUBLE) AS df2,
 {rnd("(sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) / (sum(n * s) / (sum(n) - count(*)))", 4)} AS f_value
FROM anova_groups GROUP BY gene""")(
    lambda w: rounded(S.anova(labels(w), "z_label", _M).select("gene", "df1", "df2", "f_value"), {"f_value": 4}))
job("d24_anova_significance")(lambda w: S.anova(labels(w), "z_label", _M))
job("k10_confusion_matrix", "SELECT max_label AS actual, z_label AS predicted, count(*) AS n FROM labels_by_rule GROUP BY ALL")(
    lambda w: S.confusion(labels(w), "max_label", "z_label"))
_REPORT = {"precision": 6, "recall": 6, "f1": 6}
job("k10_class_report", f"""
SELECT l AS label, {rnd("coalesce(hit / nullif(claimed, 0), 0)", 6)} AS precision, {rnd("coalesce(hit / nullif(support, 0), 0)", 6)} AS recall,
 {rnd("2 * hit / (claimed + support)", 6)} AS f1, support
FROM (SELECT s.l, count(*) FILTER (max_label = s.l AND z_label = s.l) AS hit, count(*) FILTER (max_label = s.l) AS support,
 count(*) FILTER (z_label = s.l) AS claimed FROM labels_by_rule, (SELECT DISTINCT unnest([max_label, z_label]) AS l FROM labels_by_rule) s GROUP BY s.l)""")(
    lambda w: rounded(S.class_report(S.confusion(labels(w), "max_label", "z_label")), _REPORT))
job("d25_risk_thresholds", "SELECT * FROM cuts")(lambda w: S.risk_thresholds(w["mart_risk_features_clinical"]))
job("k1_hybrid_target", "SELECT sample_id, binary_risk FROM targets")(lambda w: targets(w).select("sample_id", "binary_risk"))
job("k2_auxiliary_targets", "SELECT sample_id, biological_high_risk, survival_high_risk FROM targets")(
    lambda w: targets(w).select("sample_id", "biological_high_risk", "survival_high_risk"))
_MEANS = {"mean_age": 6, "mean_tmb": 6, "mean_mutations": 6, "mean_survival": 6}
job("d26_target_means", f"""
SELECT m.* REPLACE ({replaced(_MEANS)}), h.t > l.t AS tmb_direction_ok, h.c > l.c AS mutation_direction_ok
FROM (SELECT binary_risk, count(*) AS n, avg(age) AS mean_age, avg(tmb) AS mean_tmb, avg(mutation_count) AS mean_mutations,
 avg(target_survival_months) AS mean_survival FROM targets GROUP BY binary_risk) m,
 (SELECT avg(tmb) AS t, avg(mutation_count) AS c FROM targets WHERE binary_risk = 1) h,
 (SELECT avg(tmb) AS t, avg(mutation_count) AS c FROM targets WHERE binary_risk = 0) l""")(
    lambda w: rounded(S.target_means(targets(w)), _MEANS))
for _id, _share in [("k5_stratified_split", 0.2), ("k5_stratified_split_quarter", 0.25)]:
    job(_id, f"""
SELECT sample_id, binary_risk, CASE WHEN row_number() OVER (PARTITION BY binary_risk ORDER BY md5(sample_id || ':42'))
 <= round(count(*) OVER (PARTITION BY binary_risk) * {_share}::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM targets""")(
        lambda w, s=_share: S.stratified_split(targets(w), "binary_risk", "sample_id", s).select("sample_id", "binary_risk", "split"))
job("k6_stratified_folds", """
SELECT sample_id, binary_risk, CAST((row_number() OVER (PARTITION BY binary_risk ORDER BY md5(sample_id || ':fold:42')) - 1) % 5 AS INT) AS fold FROM targets""")(
    lambda w: S.stratified_folds(targets(w), "binary_risk", "sample_id").select("sample_id", "binary_risk", "fold"))
job("k9_class_weights", f"""
SELECT sclc_subtype, {rnd("CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*))", 9)} AS class_weight
FROM mart_risk_features_genomic GROUP BY sclc_subtype""")(
    lambda w: rounded(S.class_weights(w["genomic_features"], "sclc_subtype"), {"class_weight": 9}))
_SCORE = "CAST(mutation_count AS DOUBLE) / 6"
job("d14_scored_summary", f"""
SELECT count(*) AS n, count(*) FILTER (s >= 50) AS n_high, {rnd("count(*) FILTER (s >= 50) * 100.0::DOUBLE / count(*)", 0)} AS pct_high,
 count(*) FILTER (s >= 30 AND s < 50) AS n_moderate, {rnd("count(*) FILTER (s >= 30 AND s < 50) * 100.0::DOUBLE / count(*)", 0)} AS pct_moderate,
 count(*) FILTER (s < 30) AS n_low, {rnd("count(*) FILTER (s < 30) * 100.0::DOUBLE / count(*)", 0)} AS pct_low, {rnd("avg(s)", 6)} AS avg_score
FROM (SELECT {_SCORE} AS s FROM stg_clinical)""")(
    lambda w: rounded(S.scored_summary(w["stg_clinical"].select((F.col("mutation_count") / 6.0).alias("risk_score")).withColumn(
        "risk_level", lookups.risk_level(F.col("risk_score"), "service"))), {"avg_score": 6}))
V["info_values"] = """
UNPIVOT (SELECT lineage, primary_disease, lineage_subtype FROM sample_info) ON lineage, primary_disease, lineage_subtype INTO NAME column_name VALUE value"""
V["info_counts"] = "SELECT column_name, value, count(*) AS n FROM info_values GROUP BY ALL"
job("d31_column_profile", """
SELECT column_name, value, n, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INT) AS place,
 count(*) OVER (PARTITION BY column_name) AS n_distinct FROM info_counts QUALIFY place <= 10""")(
    lambda w: profiling.column_profile(w["sample_info"], profiling.keyword_columns(w["sample_info"].columns), 10))
