"""Logistic regression of all fits at once finds what Spark ML finds."""

import random

import pytest
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.sql import functions as F

from helixmart.operators import binned, linear, ml


def test_newton_finds_spark_s_coefficients(spark):
    r = random.Random(8)
    rows = []
    for i in range(1200):
        a, b = r.gauss(0, 1), r.gauss(0, 1)
        kind = float((a + r.gauss(0, 0.7) > 0) + (b + r.gauss(0, 0.7) > 0.5))
        rows.append((i, kind, 1.0 + kind, a, b, 3.0))  # the last feature tells nothing
    df = ml.VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        spark.createDataFrame(rows, "id int, label double, class_weight double, a double, b double, c double"))
    train, held = (df.where(w).select("id", "label", "class_weight", "features").localCheckpoint() for w in ("id % 5 > 0", "id % 5 = 0"))
    estimator = OneVsRest(classifier=LogisticRegression(maxIter=200, tol=1e-10), weightCol="class_weight")
    other = (train.where("id % 2 = 0"), held)
    whole, half = linear.fit_linear(binned.all_rows([(train, held), other]), estimator, 3, 3)
    for ours, part in ((whole, train), (half, other[0])):
        wanted = estimator.fit(part)
        for slope, model in zip(ours.slopes, wanted.models):
            assert slope[:2] == pytest.approx(model.coefficients.toArray()[:2], abs=1e-3)
            assert slope[3] + 3 * slope[2] == pytest.approx(model.intercept + 3 * model.coefficients[2], abs=1e-3)
        assert ours.train_accuracy == pytest.approx(ml._accuracy(wanted.transform(part), "label"), abs=0.003)
        assert {x["id"]: x["prediction"] for x in ours.predict(held).where(F.col("id") < 200).collect()} == {
            x["id"]: x["prediction"] for x in wanted.transform(held).where(F.col("id") < 200).collect()}


def test_apart_and_missing_classes_end(spark):
    df = ml.VectorAssembler(inputCols=["a"], outputCol="features").transform(
        spark.createDataFrame([(float(i > 9), 1.0, float(i)) for i in range(20)], "label double, class_weight double, a double")).drop("a")
    estimator = ml.classifiers()["logistic"]
    assert linear.fit_linear(binned.all_rows([(df, df)]), estimator, 1, 3)[0].held_accuracy == 1.0  # no row of the third class
    assert linear.fit_linear(binned.all_rows([(df, df)]), OneVsRest(classifier=LogisticRegression(regParam=0.1)), 1, 2) is None


def test_many_small_parts_are_few_tasks(spark, parted=40):
    df = ml.VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.range(400, numPartitions=parted).selectExpr(
        "id % 2 * 1.0D AS label", "1.0D AS class_weight", "id * 1.0D AS a"))
    rows = binned.all_rows([(df, df)] * 3)
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows.count() == 2_400
