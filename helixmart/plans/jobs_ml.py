"""Jobs around Spark ML models. Their values have no SQL form, so rows are checked and tests assert properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmart.functions import constants as C
from helixmart.operators import ml, stats as S
from helixmart.plans.check_views import rnd
from helixmart.plans.jobs_features import rounded
from helixmart.plans.jobs_stats import labels, matrix, targets
from helixmart.plans.registry import job
from helixmart.session import cut_lineage

_CANDIDATES = C.RISK_CANDIDATES[1:]
_UNION = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, binary_risk AS y, CAST({c} AS DOUBLE) AS v FROM targets" for c in _CANDIDATES)
job("k4_feature_scores", f"""
SELECT feature, {rnd("(sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) / nullif(sum(n * s) / (sum(n) - count(*)), 0)", 4)} AS score
FROM (SELECT feature, y, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM (SELECT feature, y, coalesce(v, median(v) OVER (PARTITION BY feature)) AS v
 FROM ({_UNION})) WHERE v IS NOT NULL GROUP BY feature, y) GROUP BY feature""")(
    lambda w: rounded(ml.feature_scores(targets(w), "binary_risk", _CANDIDATES), {"score": 4}))


def _scaled(w):
    columns = ["age", "mutation_count", "tmb"]
    ready = ml.as_doubles(w["mart_risk_features_clinical"].select("sample_id", *columns), columns)
    model = ml.Pipeline(stages=ml.preparation(columns)).fit(ready)
    return model.transform(ready).select("sample_id", ml.vector_to_array("features").alias("features"))


def _selected(w):
    names = ml.select_features(targets(w), "binary_risk")
    return targets(w).select("sample_id", "binary_risk", *names)


def _risk_scores(w):
    clinical = w["mart_risk_features_clinical"]
    model, _ = ml.train_risk(clinical)
    return ml.score_risk(model, ml.spread(clinical.select("sample_id", *C.RISK_FEATURES)))


def _subtype_scores(w):
    genomic = w["mart_risk_features_genomic"]
    model, _ = ml.train_subtype(genomic)
    return ml.score_subtype(model, ml.spread(genomic.select("sample_id", *C.SUBTYPE_FEATURES)))


job("k3_imputed_and_scaled")(_scaled)
job("k4_selected_features")(_selected)
job("k7_risk_forest_metrics")(lambda w: ml.train_risk(w["mart_risk_features_clinical"], folds=5)[1])
job("k8_subtype_forest_metrics")(lambda w: ml.train_subtype(w["mart_risk_features_genomic"], folds=5)[1])
job("k12_risk_scores")(_risk_scores)
job("k13_subtype_scores")(_subtype_scores)
job("f13_feature_importance")(
    lambda w: ml.importance(ml.train_risk(w["mart_risk_features_clinical"])[0], C.RISK_FEATURES))
job("f13_subtype_importance")(
    lambda w: ml.importance(ml.train_subtype(w["mart_risk_features_genomic"])[0], C.SUBTYPE_FEATURES))


def _marked(w):
    """Labelled markers, made once: the split of each comparison and model reads them again."""
    return cut_lineage(labels(w).select("sample_id", "z_label", *S.MARKERS))


def _cross_validated(marked):
    """Models whose five folds fit in minutes; boosted trees take hundreds of rounds for each class and fold."""
    return ml.compare_classifiers(marked, "z_label", S.MARKERS, folds=5)


def _best_model(marked, board):
    return ml.best_predictions(marked, "z_label", S.MARKERS, board)


def _best_report(w):
    marked = _marked(w)
    return ml.report_rows(_best_model(marked, _cross_validated(marked)))


job("k18_cross_validated")(lambda w: _cross_validated(_marked(w)))
job("k18_best_model_report")(_best_report)
# What SQL can tell about any model's report: every test sample is there once, under its own class.
job("k18_best_model_support", """
SELECT z_label AS label, CAST(round(count(*) * 0.25::DOUBLE) AS BIGINT) AS support FROM labels_by_rule GROUP BY z_label""")(
    lambda w: ml.stats.confusion(_best_model(_marked(w), ml.metric_board(w.spark, "logistic")), "actual", "predicted").groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support")))
job("k17_sample_components")(lambda w: ml.sample_components(matrix(w)))
job("k18_classifier_comparison")(
    lambda w: ml.compare_classifiers(_marked(w), "z_label", S.MARKERS))
job("k19_marker_clusters")(
    # Moments and rows read the markers from files, so the expression is shuffled once.
    lambda w: ml.cluster_markers(S.z_scores(cut_lineage(S.marker_matrix(w["core_biomarkers"])), S.MARKERS), [f"z_{m}" for m in S.MARKERS]))
