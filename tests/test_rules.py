"""Band edges, casts, marker ties and other branches the tables do not reach."""

import pytest
from pyspark.sql import functions as F

from helixmart.functions import constants as C, markers as M
from helixmart.functions.rules import band, to_bigint, to_double
from helixmart.operators import documents, evaluation, lookups, retrieval, staging, stats

EPS = 1e-6


@pytest.mark.parametrize("bands,rest", [
    (C.AGE_BANDS, None), (C.TMB_BANDS, "UNKNOWN"), (C.SURVIVAL_BANDS, None), (C.RESPONSE_BANDS, "UNKNOWN"),
    (C.SENSITIVITY_BANDS, "UNKNOWN"), (C.EFFICACY_BANDS, 20), (C.EXPRESSION_BANDS, None), (C.TEXT_TIERS, None),
    (C.IMAGE_TIERS, None), (C.RISK_CUTS["warehouse"], "LOW_RISK"), (C.RISK_CUTS["service"], "LOW_RISK")])
def test_band_edges(spark, bands, rest):
    tests = {"<": lambda v, c: v < c, "<=": lambda v, c: v <= c, ">": lambda v, c: v > c, ">=": lambda v, c: v >= c}
    values = [c + d for _, c, _ in bands for d in (-EPS, 0.0, EPS)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["b"] for r in df.select("v", band(F.col("v"), bands, rest).alias("b")).collect()}
    for v in values:
        want = rest
        if v is not None:
            want = next((label for op, cut, label in bands if tests[op](v, cut)), rest)
        assert got[v] == want, v


def test_known_band_labels(spark):
    df = spark.createDataFrame([(49,), (50,), (65,), (66,), (75,), (76,), (None,)], "v int")
    got = [r[0] for r in df.select(band(F.col("v"), C.AGE_BANDS)).collect()]
    assert got == ["YOUNG", "MIDDLE", "MIDDLE", "OLDER", "OLDER", "ELDERLY", None]


def test_safe_casts(spark):
    df = spark.createDataFrame([("12.7",), ("-0.5",), (" 12 ",), ("1e3",), ("NA",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(to_bigint(F.col("v"))).collect()] == [13, -1, 12, 1000, None, None, None]
    assert [r[0] for r in df.select(to_double(F.col("v"))).collect()] == [12.7, -0.5, 12.0, 1000.0, None, None, None]


def test_stages(spark):
    rows = [("I",), ("II",), ("IIB",), ("III",), ("IV",), ("i",), ("",), (None,), ("Extensive",)]
    base = "CAST(NULL AS STRING)"
    raw = spark.createDataFrame(rows, "stage_at_diagnosis string").selectExpr(
        "'a' sample_id", f"{base} patient_id", f"{base} study_id", "1 mutation_count", "1.0D tmb_nonsynonymous",
        "1.0D overall_survival_months", f"{base} overall_survival_status", f"{base} sex", "1 diagnosis_age",
        f"{base} smoker", f"{base} smoking_history", "stage_at_diagnosis")

    def groups(corrected):
        out = staging.clinical(raw, corrected).select("stage_at_diagnosis", "stage_group").collect()
        return {r[0]: r[1] for r in out}

    assert set(groups(False).values()) == {"STAGE_I", "UNKNOWN"}
    fixed = groups(True)
    assert (fixed["II"], fixed["IIB"], fixed["III"], fixed["IV"], fixed["i"]) == (
        "STAGE_II", "STAGE_II", "STAGE_III", "STAGE_IV", "UNKNOWN")


def marker_frame(spark, *rows):
    return spark.createDataFrame(rows, "ASCL1 double, NEUROD1 double, POU2F3 double, YAP1 double")


def cols():
    return {g: F.col(g) for g in C.SUBTYPE_MARKERS}


def test_subtype_call_and_gap(spark):
    df = marker_frame(spark, (5.0, 5.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0), (9.0, 4.0, 1.0, 1.0), (2.0, 7.0, 3.0, 1.0))
    got = [tuple(r) for r in df.select(M.subtype_call(cols()), M.confidence_gap(cols()), M.confidence_gap(cols(), True)).collect()]
    assert got == [("MIXED", 0.0, 0.0), ("MIXED", 0.0, 0.0), ("SCLC-A", 5.0, 5.0), ("SCLC-N", 7.0, 4.0)]


def test_summary_needs_all_markers(spark):
    df = marker_frame(spark, (None, 2.0, 3.0, 4.0), (4.0, 4.0, 1.0, 1.0))
    got = df.select(*M.marker_summary(cols())).collect()
    assert got[0]["dominant_tf"] is None and got[0]["dominant_value"] is None
    assert got[1]["dominant_tf"] == "ASCL1" and got[1]["ne_score"] == 4.0


def test_published_subtype_profile(spark):
    df = marker_frame(spark, (12.5, 5.0, 4.0, 5.5))
    fits = df.select(*[p.alias(s) for s, p in M.compatibility(cols()).items()]).first().asDict()
    assert fits == {"SCLC-A": 100, "SCLC-N": 15, "SCLC-P": 15, "SCLC-Y": 15}


def test_curve_flags(spark):
    raw = spark.createDataFrame([(1, 1.0, 0.0, 5.0), (1, 1.0, 10.0, None), (1, 1.0, 100.0, 15.0), (1, 1.0, 100.0, 15.1),
                                 (1, 1.0, 100.0, 30.1), (1, -1.0, 10.0, 0.0)],
                                "experiment_id bigint, concentration double, mean_pct_ctrl double, stddev_pct_ctrl double"
                                ).withColumn("count_pct_ctrl", F.lit(1))
    rows = staging.dose_response(raw).collect()
    assert [r["data_quality_flag"] for r in rows] == [
        "LOW_VARIABILITY", "NO_STDDEV", "LOW_VARIABILITY", "MODERATE_VARIABILITY", "HIGH_VARIABILITY", "LOW_VARIABILITY"]
    assert rows[0]["coefficient_variation"] is None and rows[5]["log_concentration"] is None


@pytest.mark.parametrize("c,papers,web,want", [
    (0.0, 0, 0, ("Arxiv + Web", 0.2)), (0.49, 2, 3, ("Arxiv + Web", 0.79)), (0.5, 0, 0, ("RAG + Arxiv + Web", 0.55)),
    (0.55, 2, 0, ("RAG + Arxiv", 0.65)), (0.6, 0, 0, ("RAG + Arxiv", 0.65)), (0.61, 0, 3, ("RAG", 0.61))])
def test_routes(spark, c, papers, web, want):
    df = spark.createDataFrame([(c, papers, web)], "c double, p int, w int")
    row = df.select(*retrieval.route(F.col("c"), F.col("p"), F.col("w"))).first()
    assert row["agent_used"] == want[0] and row["combined_confidence"] == pytest.approx(want[1])


def test_judge_replies(spark):
    df = spark.createDataFrame([("0.85",), ("Rate: 1",), ("1.0",), ("10",), (".8",), ("none",), (None,)], "r string")
    assert [r[0] for r in df.select(evaluation.judge_score(F.col("r"))).collect()] == [0.85, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0]


def test_input_ranges(spark):
    df = spark.createDataFrame([(75.0, 450, 18.5, 1), (121.0, 1, 1.0, 0), (50.0, -1, 1.0, 0), (50.0, 1, 1.0, 2)],
                               "age double, mutation_count int, tmb double, is_male int")
    for name in ("is_former_smoker", "is_tmb_high", "is_tmb_intermediate", "is_tmb_low"):
        df = df.withColumn(name, F.lit(0))
    assert [r["is_valid"] for r in lookups.with_validity(df).collect()] == [1, 0, 0, 0]


def test_generated_sections(spark):
    df = spark.createDataFrame([(1, "x\n1. RISK\nlong enough content here\n2. tiny\n3. **Only one line but long**")], "id int, t string")
    rows = [tuple(r) for r in documents.numbered_sections(df, "t").collect()]
    assert rows == [(1, 1, "RISK", "long enough content here"),
                    (1, 3, "Only one line but long", "Only one line but long")]


def test_field_formats(spark):
    df = spark.createDataFrame([("ab", "x@y.org"), ("a_b1", "x@y"), ("a b c", "x.y+z@a-b.co")], "username string, email string")
    rows = [(r["username_ok"], r["email_ok"]) for r in lookups.field_formats(df).collect()]
    assert rows == [(0, 1), (1, 0), (0, 1)]


def test_f_tail_matches_tables():
    import numpy as np

    f, d1, d2 = np.array([4.9646, 3.0, 0.5, 50.0]), np.array([1.0, 2.0, 3.0, 4.0]), np.array([10.0, 20.0, 30.0, 40.0])
    got = stats._f_tail(f, d1, d2)
    # P(F(1,10) > 4.9646) = 0.05; F with d1 = 2 has a closed form.
    assert got[0] == pytest.approx(0.05, abs=1e-4)
    assert got[1] == pytest.approx((1 + 2 * 3.0 / 20) ** -10, rel=1e-9)
    assert 0.68 < got[2] < 0.70 and got[3] < 1e-12


def test_wilson_contains_share(spark):
    df = spark.createDataFrame([("SCLC-A",)] * 7 + [("SCLC-N",)] * 3, "l string")
    rows = {r["subtype"]: r for r in stats.proportions(df, "l").collect()}
    assert set(rows) == set(C.SUBTYPES) and rows["SCLC-P"]["n"] == 0
    for r in rows.values():
        assert r["ci_low"] <= r["proportion"] <= r["ci_high"]
    assert rows["SCLC-A"]["ci_low"] == 0.397 and rows["SCLC-A"]["ci_high"] == 0.892
