"""Models: direction, shapes and round trips."""

import pytest
from pyspark.sql import functions as F

from helixmart.functions import constants as C
from helixmart.operators import ml
from helixmart.plans.warehouse import Warehouse


@pytest.fixture(scope="module")
def risk(spark):
    w = Warehouse(spark, "/root/testdata/sf0.01")
    clinical = w["mart_risk_features_clinical"]
    model, metrics = ml.train_risk(clinical, trees=40)
    return clinical, model, {r["metric"]: r["value"] for r in metrics.collect()}


def test_risk_model_learns(risk):
    _, _, m = risk
    assert m["roc_auc"] > 0.9 and m["test_accuracy"] > 0.8
    assert m["mean_p_actual_high"] > m["mean_p_actual_low"]


def test_scores_and_defaults(spark, risk, tmp_path):
    _, model, _ = risk
    # the published high- and low-risk patients, both without the high-burden flag
    rows = [("high", 75.0, 450.0, 18.5, 1, 0, None, 1, 0, 0.0), ("low", 52.0, 85.0, 3.2, 0, 1, None, 0, 1, 0.0)]
    names = "sample_id string, age double, mutation_count double, tmb double, is_male int, is_former_smoker int, " \
            "is_tmb_high int, is_tmb_intermediate int, is_tmb_low int, smoker_x_tmb double"
    df = spark.createDataFrame(rows, names)
    scored = {r["sample_id"]: r for r in ml.score_risk(model, df).collect()}
    assert 0 <= scored["low"]["risk_score"] < scored["high"]["risk_score"] <= 100
    assert scored["high"]["confidence"] == pytest.approx(scored["high"]["max_probability"])
    ml.save_bundle(model, str(tmp_path), C.RISK_FEATURES, "v1")
    again, about = ml.load_bundle(str(tmp_path))
    assert about["features"] == C.RISK_FEATURES and about["version"] == "v1" and len(about["importance"]) == 9
    assert ml.score_risk(again, df).where("sample_id = 'high'").first()["risk_score"] == pytest.approx(scored["high"]["risk_score"])


def test_selection_keeps_age(risk):
    from helixmart.operators import stats

    names = ml.select_features(stats.risk_targets(risk[0]), "binary_risk")
    assert names[0] == "age" and len(names) == 9 and {"tmb", "mutation_count"} <= set(names)


def test_subtype_model(spark):
    genomic = Warehouse(spark, "/root/testdata/sf0.01")["mart_risk_features_genomic"]
    model, metrics = ml.train_subtype(genomic, trees=20)
    assert {r["metric"]: r["value"] for r in metrics.collect()}["test_accuracy"] > 0.8
    row = ml.score_subtype(model, genomic.select("sample_id", *C.SUBTYPE_FEATURES)).first()
    assert set(row["probabilities"]) == set(C.SUBTYPES)
    assert sum(row["probabilities"].values()) == pytest.approx(1.0)
    assert row["confidence"] == pytest.approx(max(row["probabilities"].values()))
    assert row["probabilities"][row["predicted_subtype"]] == pytest.approx(row["confidence"])


def test_cross_validation(spark, risk):
    from helixmart.operators import stats

    ready = ml.as_doubles(stats.risk_targets(risk[0]).select("sample_id", "binary_risk", *C.RISK_FEATURES), C.RISK_FEATURES)
    ready = ready.withColumn("binary_risk", F.col("binary_risk").cast("double")).withColumn("class_weight", F.lit(1.0))
    mean, spread = ml.cross_validated(ml.risk_forest(trees=5), ready, "binary_risk", "binary_risk", "sample_id", folds=2)
    assert 0.7 < mean <= 1 and 0 <= spread < 0.2


def test_leaderboard_ties(spark):
    rows = [("a", 0.9, 0.8, 0.7, 0.2), ("b", 0.9, 0.8, 0.7, 0.1), ("c", 0.9, 0.9, 0.1, 0.5)]
    df = spark.createDataFrame(rows, "model string, train_accuracy double, test_accuracy double, cv_mean double, cv_std double")
    assert [r["model"] for r in ml.leaderboard(df).collect()] == ["c", "b", "a"]


def test_comparison_trains_whole_models(spark, monkeypatch):
    from helixmart.plans import queries

    used = []
    monkeypatch.setattr(ml, "RandomForestClassifier", lambda **k: used.append(k["numTrees"]))
    monkeypatch.setattr(ml, "GBTClassifier", lambda **k: used.append(k["maxIter"]))
    monkeypatch.setattr(ml, "OneVsRest", lambda **k: None)
    monkeypatch.setattr(ml, "preparation", lambda features: 1 / 0)  # nothing is fitted here
    with pytest.raises(ZeroDivisionError):
        queries()["k18_classifier_comparison"](spark, "/root/testdata/sf0.001")
    assert sorted(used) == [200, 300]


def test_folds_and_best_model(spark):
    import random

    r = random.Random(4)
    rows = [(f"s{i}", "xyz"[i % 3], i % 3 + r.gauss(0, 0.3), r.gauss(0, 1) if i % 5 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "sample_id string, kind string, a double, b double")
    board = ml.compare_classifiers(df, "kind", ["a", "b"], trees=10, folds=3, names=["logistic", "random_forest"])
    got = board.collect()
    assert len(got) == 2 and all(0.6 < x["cv_mean"] <= 1 and 0 <= x["cv_std"] < 0.3 for x in got)
    assert got[0]["test_accuracy"] >= got[1]["test_accuracy"]
    report = ml.report_rows(ml.best_predictions(df, "kind", ["a", "b"], board, trees=10)).collect()
    confusion = {(x["label"], x["other"]): x["value"] for x in report if x["kind"] == "confusion"}
    metrics = {(x["label"], x["other"]): x["value"] for x in report if x["kind"] == "report"}
    assert sum(confusion.values()) == 60 and sum(v for (a, b), v in confusion.items() if a == b) / 60 == pytest.approx(got[0]["test_accuracy"])
    for c in "xyz":
        assert metrics[c, "support"] == sum(v for (a, _), v in confusion.items() if a == c) == 20
        assert metrics[c, "recall"] == pytest.approx(confusion.get((c, c), 0) / 20)


def test_medians_stand_for_missing_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (None, 7.0), (4.0, None)], "a double, b double")
    assert [tuple(r) for r in ml.with_medians(df, ["a", "b"]).collect()] == [(1.0, 6.0), (2.0, 5.0), (2.0, 7.0), (4.0, 6.0)]


def test_weights_come_from_the_train_part(spark):
    rows = [(f"s{i}", "ab"[i < 30], float(i)) for i in range(100)]
    train, test = ml._split(spark.createDataFrame(rows, "sample_id string, y string, v double"), "y", "sample_id")
    n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    assert {(r["y"], round(r["class_weight"], 9)) for r in train.collect()} == {(y, round(80 / (2 * c), 9)) for y, c in n.items()}
    assert "class_weight" not in test.columns


def test_training_rows_lie_in_even_parts(spark):
    rows = spark.range(60_000).select(
        F.concat(F.lit("s"), "id").alias("sample_id"), F.when(F.col("id") % 50 == 0, "rare").otherwise("common").alias("y"), F.rand(1).alias("v"))
    train, test = ml._split(rows, "y", "sample_id")
    assert train.count() == 48_000 and test.count() == 12_000
    wanted = min(spark.sparkContext.defaultParallelism, 12)
    sizes = train.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) == wanted and max(sizes) < 1.2 * 48_000 / wanted
    assert ml.spread(rows.limit(10)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_clusters_make_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def marked(x):
        seen.add(1)
        return x

    rows = spark.range(200, numPartitions=2).select(F.col("id").cast("string").alias("sample_id"), marked((F.col("id") % 7).cast("double")).alias("z"))
    assert ml.cluster_markers(rows, ["z"], 3).count() == 200
    assert seen.value <= 400  # a checkpoint computes its rows twice at most


def test_deep_forest_keeps_the_nodes_of_its_rows(spark):
    forest = ml.classifiers(trees=4)["random_forest"]
    assert forest.getCacheNodeIds() and forest.getMaxDepth() == 15
    rows = spark.range(3_000, numPartitions=3).select(F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn(
        "label", F.floor(F.col("a") * F.col("b") * 7) % 3 * 1.0).withColumn("class_weight", F.col("label") + 1)
    ready = ml.VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    walked = forest.copy().setCacheNodeIds(False)
    trees = [[t.toDebugString.split("\n", 1)[1] for t in f.fit(ready).trees] for f in (forest, walked)]
    assert trees[0] == trees[1] and max(map(len, trees[0])) > 1_000
