"""SQL scoring functions against the models they come from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmart.functions import constants as C
from helixmart.operators import ml, scoring
from helixmart.plans import queries
from helixmart.plans.warehouse import Warehouse


@pytest.fixture(scope="module")
def w(spark):
    return Warehouse(spark, "/root/testdata/sf0.001")


def test_risk_equals_the_model(spark, w, tmp_path):
    clinical = w["mart_risk_features_clinical"]
    model, _ = ml.train_risk(clinical, trees=20)
    scoring.export_bundle(model, str(tmp_path), C.RISK_FEATURES)
    scoring.register_risk(spark, str(tmp_path))
    gaps = clinical.select("sample_id", *C.RISK_FEATURES).withColumn("tmb", F.when(F.crc32("sample_id") % 3 != 0, F.col("tmb"))).withColumn(
        "is_male", F.when(F.crc32("sample_id") % 5 != 0, F.col("is_male")))
    gaps.createOrReplaceTempView("gaps")
    got = {r["sample_id"]: r["s"] for r in spark.sql(
        f"SELECT sample_id, predict_risk({', '.join(f'CAST({c} AS DOUBLE)' for c in C.RISK_FEATURES)}) AS s FROM gaps").collect()}
    for r in ml.score_risk(model, gaps).collect():
        s = got[r["sample_id"]]
        assert s["risk_score"] == pytest.approx(r["risk_score"], abs=1e-9) and s["risk_level"] == r["risk_level"]
        assert s["confidence"] == pytest.approx(r["confidence"], abs=1e-9) and s["predicted_class"] == r["predicted_class"]


def test_subtype_equals_the_model(spark, w, tmp_path):
    genomic = w["mart_risk_features_genomic"]
    model, _ = ml.train_subtype(genomic, trees=10)
    scoring.export_bundle(model, str(tmp_path), C.SUBTYPE_FEATURES)
    predict = scoring.register_subtype(spark, str(tmp_path))
    got = {r["sample_id"]: r["s"] for r in genomic.select("sample_id", predict(*[F.col(c).cast("double") for c in C.SUBTYPE_FEATURES]).alias("s")).collect()}
    for r in ml.score_subtype(model, genomic.select("sample_id", *C.SUBTYPE_FEATURES)).collect():
        s = got[r["sample_id"]]
        assert s["predicted_subtype"] == r["predicted_subtype"]
        assert s["probabilities"].keys() == r["probabilities"].keys()
        assert all(s["probabilities"][k] == pytest.approx(v, abs=1e-9) for k, v in r["probabilities"].items())


def test_bundle_is_loaded_once(tmp_path, spark, w):
    clinical = w["mart_risk_features_clinical"]
    scoring.export_bundle(ml.train_risk(clinical, trees=3)[0], str(tmp_path), C.RISK_FEATURES)
    forest = scoring.Forest.load(str(tmp_path))
    assert scoring.Forest.load(str(tmp_path)) is forest
    p = forest.probabilities(np.full((2, len(C.RISK_FEATURES)), np.nan))
    assert p.shape == (2, 2) and np.allclose(p.sum(axis=1), 1)


def test_analyses_hold_score_prompt_and_neighbours(spark, w):
    jobs, folder = queries(), "/root/testdata/sf0.001"
    scores = {r["sample_id"]: r for r in jobs["m1_predict_risk"](spark, folder).collect()}
    patients = w["mart_risk_features_clinical"].count()
    assert len(scores) == patients
    for name in ("m3_risk_analysis_scored", "m5_risk_analysis_scored", "m6_risk_flow_scored"):
        rows = jobs[name](spark, folder).collect()
        assert len(rows) == patients
        assert all(r["risk_score"] == pytest.approx(scores[r["sample_id"]]["risk_score"]) for r in rows)
    labels = {r["sample_id"]: r["predicted_subtype"] for r in jobs["m2_predict_subtype"](spark, folder).collect()}
    for name in ("m4_subtype_analysis_scored", "m6_subtype_flow_scored"):
        rows = jobs[name](spark, folder).collect()
        assert len(rows) == len(labels) and all(r["predicted_subtype"] == labels[r["sample_id"]] for r in rows)
    row = jobs["m3_risk_analysis_scored"](spark, folder).first()
    assert f"Risk score {row['risk_score']:.3f}" in row["prompt"]
