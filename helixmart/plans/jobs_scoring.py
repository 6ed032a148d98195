"""Analyses with the trained models, through SQL functions. Scores have no SQL form, so these give rows only; tests hold
them against the models."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmart.functions import constants as C
from helixmart.operators import documents as D, lookups, ml, scoring, similarity as S
from helixmart.plans.jobs_documents import _TERMS, chunks
from helixmart.plans.jobs_similarity import clinical
from helixmart.plans.registry import job
from helixmart.session import scratch_dir

#: (application, data folder, model) -> bundle folder: a session trains each model once per data folder.
_BUNDLES: dict[tuple[str, str, str], str] = {}


def bundle(w, kind: str) -> str:
    key = (w.spark.sparkContext.applicationId, w.folder, kind)
    if key not in _BUNDLES:
        folder = scratch_dir(w.spark, f"{kind}-bundle")
        if kind == "risk":
            scoring.export_bundle(ml.train_risk(clinical(w))[0], folder, C.RISK_FEATURES)
        else:
            scoring.export_bundle(ml.train_subtype(w["mart_risk_features_genomic"])[0], folder, C.SUBTYPE_FEATURES)
        _BUNDLES[key] = folder
    return _BUNDLES[key]


def _called(table: str, function: str, features: list[str], keep: str = "*") -> str:
    return f"SELECT {keep}, {function}({', '.join(f'CAST({c} AS DOUBLE)' for c in features)}) AS scored FROM {table}"


def risk_scored(w):
    """Patients with risk_score, risk_level, confidence and class by the SQL function."""
    scoring.register_risk(w.spark, bundle(w, "risk"))
    ml.spread(clinical(w)).createOrReplaceTempView("scored_patients")
    return w.spark.sql(_called("scored_patients", "predict_risk", C.RISK_FEATURES)).select("*", "scored.*").drop("scored")


def subtype_scored(w):
    """Samples with predicted_subtype, confidence and probabilities by the SQL function."""
    scoring.register_subtype(w.spark, bundle(w, "subtype"))
    ml.spread(w["mart_risk_features_genomic"]).createOrReplaceTempView("scored_samples")
    return w.spark.sql(_called("scored_samples", "predict_subtype", C.SUBTYPE_FEATURES)).select("*", "scored.*").drop("scored")


job("m1_predict_risk")(lambda w: risk_scored(w).select("sample_id", "risk_score", "risk_level", "confidence", "predicted_class"))
job("m2_predict_subtype")(lambda w: subtype_scored(w).select("sample_id", "predicted_subtype", "confidence", "probabilities"))
job("m3_risk_analysis_scored")(lambda w: S.risk_analysis(risk_scored(w).drop("risk_level"), clinical(w)))
job("m4_subtype_analysis_scored")(
    lambda w: S.subtype_analysis_of_all(w["genomic_features"], subtype_scored(w), "predicted_subtype", ["confidence", "probabilities"]))


def risk_with_evidence(w):
    """Score, level, five nearest patients, literature text and prompt, one row per patient."""
    found = D.evidence_summary(D.evidence(chunks(w), terms=_TERMS)).select(F.struct("n_papers", "summary").alias("e"))
    return (
        S.with_burden_neighbours(risk_scored(w), clinical(w)).withColumn("e", found.scalar())
        .select("sample_id", "risk_score", "risk_level", "similar_patients_found", "closest",
                D.search_phrase(F.col("risk_score")).alias("search_terms"), "e.n_papers", "e.summary", S.risk_prompt(F.col("risk_score")).alias("prompt"))
    )


job("m5_risk_analysis_scored")(risk_with_evidence)
job("m6_risk_flow_scored")(lambda w: S.risk_flow(risk_scored(w).drop("risk_level"), clinical(w)).join(
    risk_scored(w).select("sample_id", "risk_score"), "sample_id"))
job("m6_subtype_flow_scored")(lambda w: S.subtype_flow_of_all(subtype_scored(w), w["genomic_features"], "predicted_subtype"))
