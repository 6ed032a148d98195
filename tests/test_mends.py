"""Non-finite values, whole results without limits, visitors, order of extracts."""

from pyspark.sql import functions as F

from helixmart.functions.rules import to_double
from helixmart.operators import documents, events, similarity
from helixmart.operators.ranking import group_quantiles
from helixmart.plans import oracle_sql, queries


def test_non_finite_texts_are_no_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("Infinity",), ("-inf",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(to_double(F.col("t"))).collect()] == [1.5] + [None] * 5


def test_quantiles_leave_out_non_finite_values(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, float("nan"), float("inf"), float("-inf"), None)], "k string, v double")
    assert group_quantiles(df, ["k"], "v", {"m": 0.5}).collect()[0]["m"] == 2.0


def test_ids_and_entries_are_not_cut(spark):
    ids = spark.range(1500).select(F.col("id").alias("p"), F.col("id").cast("string").alias("i"))
    assert documents.unique_in_order(ids, "i", "p").count() == 1500
    assert documents.unique_in_order(ids, "i", "p", 1000).count() == 1000
    text = "".join(f"**{n}. Name {n}** body {n}\n" for n in range(1, 9))
    got = documents.numbered_names(spark.createDataFrame([(1, text)], "id int, t string"), "t").orderBy("entry").collect()
    assert [(r["entry"], r["name"], r["body"]) for r in got] == [(n, f"Name {n}", f"body {n}") for n in range(1, 9)]


def test_anonymous_visitors_are_told_apart_by_session(spark):
    rows = [("anonymous", "s1"), ("anonymous", "s2"), ("u", "s1"), ("anonymous", "unknown"), (None, None)]
    df = spark.createDataFrame(rows, "user_id string, session_id string").withColumn("app_timestamp", F.timestamp_seconds(F.lit(1_700_000_000)))
    assert sorted(r["visitor"] for r in events.gap_sessions(df).collect()) == ["anonymous", "session s1", "session s2", "u"]


def test_extracts_are_in_order(spark, tiny):
    rows = queries()["a14_export_clinical_features"](spark, tiny).collect()
    keys = [r["sample_id"] for r in rows]
    assert len(keys) > 1 and keys == sorted(keys)
    assert "ORDER BY" in oracle_sql()["k20_genomic_training_extract"]


def test_repeated_patients_are_not_multiplied(spark):
    rows = [("a", 50, 2.0, 1, 3.0, 10), ("a", 50, 2.0, 1, 3.0, 10), ("a", 70, 9.0, 0, 5.0, 20), ("b", None, 1.0, 1, 2.0, 5)]
    df = spark.createDataFrame(rows, "sample_id string, age long, tmb double, is_male int, risk_score double, mutation_count long")
    got = sorted((r["sample_id"], r["similar_patients_found"]) for r in similarity.risk_analysis(df, df).collect())
    assert got == [("a", 1), ("a", 2), ("a", 2), ("b", 0)]


def test_small_groups_are_sorted_after_one_shuffle(spark):
    from helixmart.operators import marts
    from helixmart.operators.ranking import quantiles_of_many_groups

    rows = [("large", float(i * i % 31)) for i in range(40)] + [("small", 0.1), ("small", 0.7), ("one", 5.0), ("odd", float("nan")), (None, 1.0), ("odd", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q1": 0.1, "m": 0.5, "q9": 0.9}
    wanted = {tuple(r) for r in group_quantiles(df, ["k"], "v", probs).collect()}
    for gathered in (0, 10, 100):
        assert {tuple(r) for r in quantiles_of_many_groups(df, ["k"], "v", probs, gathered).select("k", *probs).collect()} == wanted
    expression = spark.createDataFrame([("a", "G", 1.0), ("a", "H", 4.0)], "sample_id string, gene_symbol string, expression_value double")
    plan = marts.gene_summary(expression)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and marts.gene_summary(expression).first()["median_gene_expression"] == 2.5


def test_patients_of_one_id_keep_their_own_neighbours(spark):
    rows = [(f"p{i}", 50 + i % 2 * 30, i / 8.0) for i in range(12)] + [("twice", 50, 0.0), ("twice", 80, 0.0), ("none", None, 1.0)]
    patients = spark.createDataFrame(rows, "sample_id string, age int, tmb double")
    found = similarity.with_burden_neighbours(patients, patients)
    got = {(r["sample_id"], r["age"]): (r["similar_patients_found"], r["closest"]) for r in found.collect()}
    assert len(got) == len(rows) and got["none", None] == (0, None)
    assert got["twice", 50] == (5, "p0,twice,p2,p4,p6") and got["twice", 80] == (5, "twice,p1,p3,p5,p7")


def test_profiles_are_computed_once(spark, tiny):
    for name in ("c14_nearest_profiles_of_all", "c14_agreement_of_all", "c13_similar_profiles_of_all"):
        assert "parquet" not in queries()[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString(), name
