"""Shapes of the physical plans that matter at scale."""

import pytest

from compare import plan
from helixmart.operators import marts, staging
from helixmart.plans.warehouse import Warehouse, build


@pytest.fixture
def w(spark, tiny):
    return Warehouse(spark, tiny)


def test_pivot_is_one_shuffle(w):
    core = marts.biomarkers(staging.gene_expression(w["gene_expression"]))
    text = plan(core)
    source = plan(w["gene_expression"])
    assert text.count("Exchange hashpartitioning") - source.count("Exchange hashpartitioning") == 1


def test_rank_limit_runs_before_the_shuffle(w):
    text = plan(w["top_drugs"])
    assert text.count("WindowGroupLimit") == 2
    final = text.index("WindowGroupLimit")
    assert "Exchange" in text[final:text.rindex("WindowGroupLimit")]


def test_anti_joins_and_pruned_scans(w):
    from helixmart.operators import documents

    assert "LeftAnti" in plan(documents.unprocessed(w["papers"], w["text_processed"]))
    text = plan(w["mart_drug_sensitivity"].select("experiment_id", "log_ic50"))
    assert "o_comment" not in text and "o_totalprice" not in text


def test_recommendations_have_no_python(w):
    text = plan(w["mart_treatment_recommendations"])
    assert "Python" not in text and "MapInPandas" not in text


def test_build_stores_marts_and_reuses_them(spark, tiny, tmp_path):
    w = Warehouse(spark, tiny)
    lazy = w["mart_treatment_recommendations"].count()
    w = Warehouse(spark, tiny)
    written = build(w, str(tmp_path))
    assert "mart_treatment_recommendations" in written and "stg_clinical" not in written
    assert w["mart_treatment_recommendations"].count() == lazy
    assert str(tmp_path) in plan(w["mart_risk_features_combined"])


def test_hot_cells_are_cut_before_the_shuffle(w):
    from helixmart.operators import profiles, similarity

    clinical = w["mart_risk_features_clinical"]
    text = plan(similarity.nearest_by_burden(clinical, clinical))
    assert text.count("WindowGroupLimit") == 2  # k per query, before and after
    text = plan(profiles.first_of_cells(clinical, ["age", "tmb"], "sample_id", 5))
    assert text.count("WindowGroupLimit") == 2  # k per cell


def test_range_joins_meet_no_bins(spark, w):
    """Without broadcasts, the only keys that ranges meet on are leaves and whole points."""
    from helixmart.operators import similarity

    clinical = w["mart_risk_features_clinical"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for frame in (similarity.count_similar(clinical, clinical), similarity.nearest_by_age_and_burden(clinical, clinical)):
            text = plan(frame)
            assert "Generate explode" not in text and "NestedLoop" not in text and "Cartesian" not in text and "_bin" not in text
        rows = similarity.count_similar(clinical, clinical).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == clinical.count()
