"""Trees over cells give what Spark ML gives over rows."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from helixmart.operators import binned, ml


@pytest.fixture(scope="module")
def parts(spark):
    """A train and a held part of three classes; a has a heavy value, b many values, c few."""
    r = random.Random(3)

    def rows(n):
        out = []
        for _ in range(n):
            a, b, c = r.choice([0.0, 0.0, r.gauss(0, 1)]), r.gauss(0, 1), float(r.randrange(4))
            kind = float((a + b > 0.4) + (c * b > 0.6 or r.random() < 0.1))
            out.append((kind, [0.5, 1.0, 2.0][int(kind)], a, b, c))
        return spark.createDataFrame(out, "label double, class_weight double, a double, b double, c double")

    assemble = ml.VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")
    return tuple(assemble.transform(rows(n)).select("label", "class_weight", "features").localCheckpoint() for n in (900, 200))


def test_boosted_cells_are_spark_s_boosted_rows(spark, parts):
    train, held = parts
    estimator = OneVsRest(classifier=GBTClassifier(maxIter=12, stepSize=0.07, maxDepth=3, seed=42))
    model, = binned.fit_cells([parts], estimator, 3, 3)
    wanted = estimator.fit(train)
    assert (model.train_accuracy, model.held_accuracy) == pytest.approx((ml._accuracy(wanted.transform(train), "label"), ml._accuracy(wanted.transform(held), "label")))
    ours = model.predict(held.withColumn("at", F.monotonically_increasing_id()))
    theirs = wanted.transform(held.withColumn("at", F.monotonically_increasing_id()))
    assert {r["at"]: r["prediction"] for r in ours.collect()} == {r["at"]: r["prediction"] for r in theirs.select("at", "prediction").collect()}


def test_a_tree_over_cells_is_spark_s_tree(spark, parts):
    train, _ = parts
    wanted = DecisionTreeClassifier(maxDepth=7, minInstancesPerNode=2, weightCol="class_weight", seed=42).fit(train)
    rows = binned.all_rows([(train, train.limit(0))])
    cuts = binned._thresholds(rows, 3, 32, True)
    seen = binned._celled(rows, cuts, 3, 32).groupBy("cell", "label").agg(F.count("*").alias("n"), F.sum("class_weight").alias("w")).toPandas()
    cells, place = np.unique(seen["cell"], return_inverse=True)
    bins = np.stack([cells // 32 ** (2 - f) % 32 for f in range(3)], 1)
    shares = binned.grow(bins, np.array([len(cuts[0, f]) + 1 for f in range(3)]), place, seen["label"].to_numpy(int), seen["w"].to_numpy(),
                         seen["n"].to_numpy(), 3, 7, 2, 3, np.random.default_rng(1))
    theirs = wanted.transform(train).select(F.lit(0).alias("fit"), vector_to_array("features").alias("x"), vector_to_array("probability").alias("p"))
    for r in binned._celled(theirs, cuts, 3, 32).collect():
        assert shares[np.searchsorted(cells, r["cell"])] == pytest.approx(r["p"])


def test_a_forest_over_cells_learns_like_spark_s(parts):
    forest = ml.classifiers(trees=40)["random_forest"]
    model, = binned.fit_cells([parts], forest, 3, 3)
    wanted = forest.fit(parts[0])
    assert model.held_accuracy == pytest.approx(ml._accuracy(wanted.transform(parts[1]), "label"), abs=0.06)
    again, = binned.fit_cells([(parts[0].repartition(5), parts[1])], forest, 3, 3)
    assert (again.train_accuracy, again.held_accuracy) == (model.train_accuracy, model.held_accuracy)


def test_copies_of_rows_add_no_cells(parts):
    estimator = OneVsRest(classifier=GBTClassifier(maxIter=3, maxDepth=3, seed=42))
    train = parts[0].withColumn("_", F.explode(F.array(*map(F.lit, range(5))))).drop("_")
    once, many = (binned.fit_cells([(t, parts[1])], estimator, 3, 3)[0] for t in (parts[0], train))
    assert len(once.cells) == len(many.cells) and once.held_accuracy == many.held_accuracy


def test_too_many_cells_and_other_models_are_left_to_spark(parts, monkeypatch):
    boosted = OneVsRest(classifier=GBTClassifier(maxIter=2, maxDepth=2, seed=42))
    assert binned.fit_cells([parts], OneVsRest(classifier=LogisticRegression()), 3, 3) is None
    whole = ml._scores([parts], boosted, 3, 3)
    monkeypatch.setattr(binned, "MAX_CELLS", 3)
    assert binned.fit_cells([parts], boosted, 3, 3) is None
    assert ml._scores([parts], boosted, 3, 3) == [pytest.approx(whole[0])]
