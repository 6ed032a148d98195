"""Checks that ride on a build: values, and no scan beyond the build's own."""

from pyspark.sql import functions as F

from helixmart.operators import marts, quality
from helixmart.plans import warehouse
from helixmart.plans.warehouse import MATERIALISED, Warehouse, build, build_observed


def test_report_needs_no_job_of_its_own(spark, tiny, tmp_path):
    w = Warehouse(spark, tiny)
    report = build_observed(w, str(tmp_path))
    rows = {(r["check_name"], r["key"]): r["value"] for r in report.collect()}
    for name in MATERIALISED:
        assert rows["rows", name] == spark.read.parquet(f"{tmp_path}/{name}").count()
    clinical = rows["rows", "mart_risk_features_clinical"]
    assert rows["is_male", "0"] + rows["is_male", "1"] + rows["is_male", "other"] == clinical
    assert rows["clinical_id_format", "well_formed"] + rows["clinical_id_format", "other"] == rows["rows", "stg_clinical"]
    assert rows["panel", "other"] + sum(v for (c, k), v in rows.items() if c == "panel" and k != "other") == rows["rows", "cell_lines"]
    assert {t for c, t in rows if c == "rows"} == set(quality.OBSERVED)


def test_marts_read_stored_ones(spark, tiny, tmp_path):
    w = Warehouse(spark, tiny)
    build_observed(w, str(tmp_path))
    assert all(w.is_stored(n) for n in MATERIALISED)


def test_id_format(spark):
    df = spark.createDataFrame([("S1",), ("S-1.A_2",), (" s1",), ("",), (None,), ("-X",)], "sample_id string")
    checks = quality._ids("f")
    row = df.agg(*[c.alias(k) for (_, k), c in checks.items()]).first()
    assert (row["well_formed"], row["other"]) == (2, 4)


def test_expression_rows_are_joined_once(spark, tiny, tmp_path):
    from compare import plan

    w = Warehouse(spark, tiny)
    lazy = {n: sorted(w[n].collect(), key=str) for n in ("core_biomarkers", "mart_risk_features_combined")}
    view = sorted(w["stg_gene_expression"].collect(), key=str)
    w = Warehouse(spark, tiny)
    build(w, str(tmp_path))
    assert sorted(w["stg_gene_expression"].collect(), key=str) == view
    for frame in (marts.biomarkers(w["stg_gene_expression"]), w["gene_summary"]):
        assert str(tmp_path) in plan(frame) and "l_orderkey" not in plan(frame)
    assert {n: [r[0] for r in sorted(w[n].collect(), key=str)] for n in lazy} == {n: [r[0] for r in rows] for n, rows in lazy.items()}


def test_build_keeps_the_settings_of_the_session(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        own = warehouse._same_settings(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert own is not spark and own.conf.get("spark.sql.shuffle.partitions") == "5"


def test_summary_of_large_and_small_samples(spark):
    rows = [(s, f"G{i % 3}", float(i * i % 7)) for s, n in (("large", 40), ("small", 4), ("one", 1)) for i in range(n)] + [("none", "G", None)]
    df = spark.createDataFrame(rows, "sample_id string, gene_symbol string, expression_value double")

    def rounded(frame):
        return {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect()}

    median = df.groupBy("sample_id").agg(F.expr("median(expression_value)").alias("median_gene_expression"))
    wanted = rounded(marts.gene_moments(df).join(median, "sample_id"))
    assert all(rounded(marts.gene_summary(df, gathered)) == wanted for gathered in (0, 10, 100))
    # One grouping for small samples: no distinct count, which would shuffle every gene of a sample.
    lines = marts.gene_summary(df)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Aggregate" in line and "collect_set" in line and "collect_list" in line and "stddev_samp" in line for line in lines)
