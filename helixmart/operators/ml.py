"""Model training, evaluation and batch scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    PCA, Imputer, StandardScaler, StringIndexer, UnivariateFeatureSelector, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixmart.functions import constants as C
from helixmart.operators import binned, linear, stats
from helixmart.operators.components import leading_components
from helixmart.operators.lookups import risk_level, scoring_defaults
from helixmart.operators.ranking import group_quantiles
from helixmart.session import cut_lineage, task_count

SEED = 42
#: Rows of a part of a training set: fewer are not worth a task, more are cut further.
ROWS_AT_LEAST, ROWS_AT_MOST = 4_000, 50_000


# -- preparation -------------------------------------------------------------------------------

def as_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def preparation(columns: Sequence[str], output: str = "features") -> list:
    """Median imputation, assembling and standard scaling as pipeline stages."""
    filled = [f"{c}_filled" for c in columns]
    return [
        Imputer(strategy="median", inputCols=list(columns), outputCols=filled, relativeError=1e-4),
        VectorAssembler(inputCols=filled, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol=output, withMean=True, withStd=True),
    ]


def with_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, missing values replaced by the column's exact median; no column is gathered in a task."""
    ready = as_doubles(df, columns)
    long = ready.select(*columns).unpivot([], list(columns), "feature", "value")
    # One row per column.
    middles = {r["feature"]: r["m"] for r in group_quantiles(long, ["feature"], "value", {"m": 0.5}).collect()}
    return ready.fillna({c: m for c, m in middles.items() if m is not None})


def feature_scores(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """ANOVA F of each candidate against a class label, from group sums in one pass; medians stand for missing values."""
    df = with_medians(df, columns)
    long = df.select(F.col(label).alias("y"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["y"], list(columns), "feature", "value").where(F.col("value").isNotNull())
    groups = long.groupBy("feature", "y").agg(
        F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    sums = groups.groupBy("feature").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = (F.col("sq") - F.col("s") * F.col("s") / F.col("n")) / F.nullif(F.col("k") - 1, F.lit(0))
    return sums.select("feature", (between / F.nullif(F.col("within") / (F.col("n") - F.col("k")), F.lit(0.0))).alias("score"))


def select_features(df: DataFrame, label: str, keep: int = 9, forced: str = "age",
                    candidates: Sequence[str] = tuple(C.RISK_CANDIDATES)) -> list[str]:
    """The forced feature plus the keep - 1 best of the rest by ANOVA F."""
    rest = [c for c in candidates if c != forced]
    stages = [
        VectorAssembler(inputCols=rest, outputCol="candidates"),
        UnivariateFeatureSelector(featuresCol="candidates", outputCol="chosen", labelCol=label, selectionMode="numTopFeatures")
        .setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(keep - 1),
    ]
    ready = with_medians(df, rest).withColumn(label, F.col(label).cast("double"))
    chosen = Pipeline(stages=stages).fit(ready).stages[-1].selectedFeatures
    return [forced, *[rest[i] for i in sorted(chosen)]]


def _weighted(df: DataFrame, label: str) -> DataFrame:
    # One row per class; a shuffle by class would put all rows into as many tasks as there are classes.
    return df.join(F.broadcast(stats.class_weights(df, label)), label)


def _even(df: DataFrame, identity: str, rows: int) -> DataFrame:
    """The ``rows`` rows in even, ordered parts: training goes over them hundreds of times, in as many tasks as there are
    parts. A few bytes a row would make adaptive execution put them all into one."""
    parts = max(min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_AT_LEAST)), -(-rows // ROWS_AT_MOST), 1)
    return df.repartition(parts, identity).sortWithinPartitions(identity)


def _split(df: DataFrame, label: str, identity: str, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Stable train and test parts; checkpointed because training reads them many times. The train part has the column
    class_weight, from its own classes alone."""
    whole = cut_lineage(stats.stratified_split(df, label, identity, share))
    train, test = whole.where("split = 'train'").drop("split"), whole.where("split = 'test'").drop("split")
    return cut_lineage(_even(_weighted(train, label), identity, train.count())), cut_lineage(_even(test, identity, test.count()))


# -- models ------------------------------------------------------------------------------------

def risk_forest(features: Sequence[str] = tuple(C.RISK_FEATURES), trees: int = 200) -> Pipeline:
    return Pipeline(stages=[
        *preparation(features),
        RandomForestClassifier(
            labelCol="binary_risk", featuresCol="features", weightCol="class_weight", numTrees=trees, maxDepth=5,
            minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=SEED),
    ])


def subtype_forest(features: Sequence[str] = tuple(C.SUBTYPE_FEATURES), trees: int = 100) -> Pipeline:
    return Pipeline(stages=[
        StringIndexer(inputCol="sclc_subtype", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"),
        *preparation(features),
        RandomForestClassifier(
            labelCol="label", featuresCol="features", weightCol="class_weight", numTrees=trees, maxDepth=8,
            minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=SEED),
    ])


def _accuracy(scored: DataFrame, label: str) -> float:
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy").evaluate(scored)


def cross_validated(pipeline: Pipeline, train: DataFrame, label: str, class_label: str, identity: str,
                    folds: int = 5) -> tuple[float, float]:
    """Mean and deviation of accuracy over stratified folds, whose models are fitted side by side."""
    with_folds = cut_lineage(_even(stats.stratified_folds(train, class_label, identity, folds), identity, train.count()))
    search = CrossValidator(
        estimator=pipeline, estimatorParamMaps=ParamGridBuilder().build(), numFolds=folds, foldCol="fold", parallelism=folds,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy"))
    found = search.fit(with_folds)
    return float(found.avgMetrics[0]), float(found.stdMetrics[0])


def metric_rows(df: DataFrame, metrics: dict[str, float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in metrics.items()], "metric string, value double")


def train_risk(clinical: DataFrame, features: Sequence[str] = tuple(C.RISK_FEATURES), trees: int = 200,
               folds: int = 0) -> tuple[PipelineModel, DataFrame]:
    """Fit on 80 % and report train/test accuracy, gap, AUC and the learning check on the rest."""
    ready = as_doubles(stats.risk_targets(clinical).select("sample_id", "binary_risk", *features), features).withColumn(
        "binary_risk", F.col("binary_risk").cast("double"))
    train, test = _split(ready, "binary_risk", "sample_id")
    pipeline = risk_forest(features, trees)
    model = pipeline.fit(train)
    scored = model.transform(test).withColumn("p_high", vector_to_array("probability")[1])
    train_accuracy, test_accuracy = _accuracy(model.transform(train), "binary_risk"), _accuracy(scored, "binary_risk")
    auc = BinaryClassificationEvaluator(labelCol="binary_risk", rawPredictionCol="rawPrediction").evaluate(scored)
    learned = scored.agg(
        F.avg(F.when(F.col("binary_risk") == 1, F.col("p_high"))).alias("high"),
        F.avg(F.when(F.col("binary_risk") == 0, F.col("p_high"))).alias("low")).first()
    metrics = {
        "train_accuracy": train_accuracy, "test_accuracy": test_accuracy, "overfit_gap": train_accuracy - test_accuracy,
        "roc_auc": auc, "mean_p_actual_high": learned["high"], "mean_p_actual_low": learned["low"],
    }
    if folds:
        metrics["cv_mean"], metrics["cv_std"] = cross_validated(pipeline, train, "binary_risk", "binary_risk", "sample_id", folds)
    return model, metric_rows(clinical, metrics)


def train_subtype(genomic: DataFrame, trees: int = 100, folds: int = 0) -> tuple[PipelineModel, DataFrame]:
    ready = as_doubles(genomic.select("sample_id", "sclc_subtype", *C.SUBTYPE_FEATURES), C.SUBTYPE_FEATURES)
    train, test = _split(ready, "sclc_subtype", "sample_id")
    pipeline = subtype_forest(trees=trees)
    model = pipeline.fit(train)
    train_accuracy, test_accuracy = _accuracy(model.transform(train), "label"), _accuracy(model.transform(test), "label")
    metrics = {"train_accuracy": train_accuracy, "test_accuracy": test_accuracy, "overfit_gap": train_accuracy - test_accuracy}
    if folds:
        metrics["cv_mean"], metrics["cv_std"] = cross_validated(pipeline, train, "label", "sclc_subtype", "sample_id", folds)
    return model, metric_rows(genomic, metrics)


def importance(model: PipelineModel, features: Sequence[str], top: int = 10) -> DataFrame:
    """Feature importances, best first; as many rows as the model has features."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return _session().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def _session() -> SparkSession:
    return SparkSession.active()


# -- scoring -----------------------------------------------------------------------------------

def spread(rows: DataFrame, identity: str = "sample_id") -> DataFrame:
    """Every tree of a forest is walked for each row, so the number of tasks must not come from the bytes of a row."""
    return rows.repartition(task_count(rows.sparkSession), identity)


def score_risk(model: PipelineModel, patients: DataFrame, features: Sequence[str] = tuple(C.RISK_FEATURES),
               profile: str = "warehouse") -> DataFrame:
    """Score 0-100, level, confidence and class for every patient; missing flags count as 0."""
    ready = as_doubles(scoring_defaults(patients), features)
    p = vector_to_array("probability")
    out = model.transform(ready).withColumn("_p", p)
    return out.select(
        *patients.columns, (F.col("_p")[1] * 100).alias("risk_score"),
        risk_level(F.col("_p")[1] * 100, profile).alias("risk_level"),
        F.element_at("_p", F.col("prediction").cast("int") + 1).alias("confidence"),
        F.array_max("_p").alias("max_probability"), F.col("prediction").cast("int").alias("predicted_class"))


def score_subtype(model: PipelineModel, samples: DataFrame) -> DataFrame:
    """Predicted subtype, confidence and a map from subtype to probability."""
    names = model.stages[0].labels
    labels = F.array(*[F.lit(n) for n in names])
    ready = as_doubles(samples, C.SUBTYPE_FEATURES)
    rest = model.copy()
    rest.stages = model.stages[1:]
    out = rest.transform(ready).withColumn("_p", vector_to_array("probability"))
    return out.select(
        *samples.columns, F.element_at(labels, F.col("prediction").cast("int") + 1).alias("predicted_subtype"),
        F.array_max("_p").alias("confidence"), F.map_from_arrays(labels, F.col("_p")).alias("probabilities"))


def save_bundle(model: PipelineModel, path: str, features: Sequence[str], version: str) -> None:
    """Model folder plus a one-row JSON table with the feature list, importances and version."""
    model.write().overwrite().save(f"{path}/model")
    last = model.stages[-1]
    values = last.featureImportances.toArray().tolist() if hasattr(last, "featureImportances") else []
    _session().createDataFrame(
        [(list(features), values, version)], "features array<string>, importance array<double>, version string"
    ).coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_bundle(path: str) -> tuple[PipelineModel, dict]:
    about = _session().read.schema("features array<string>, importance array<double>, version string").json(f"{path}/about").first()
    return PipelineModel.load(f"{path}/model"), about.asDict()


# -- comparison, clustering, components ----------------------------------------------------------

def classifiers(trees: int = 300, rounds: int = 200) -> dict:
    """The compared estimators; the binary models of one-vs-rest are fitted side by side. Deep trees keep the node that a row
    has reached: without it each level walks every row from the root of every tree. The splits are the same."""
    boosted = GBTClassifier(maxIter=rounds, stepSize=0.07, maxDepth=3, seed=SEED)
    return {
        "logistic": OneVsRest(classifier=LogisticRegression(maxIter=200), weightCol="class_weight", parallelism=4),
        "random_forest": RandomForestClassifier(
            numTrees=trees, maxDepth=15, minInstancesPerNode=2, weightCol="class_weight", seed=SEED, cacheNodeIds=True),
        "boosted_trees": OneVsRest(classifier=boosted, parallelism=4),
    }


def _labelled(labelled: DataFrame, label: str, features: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    indexer = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(as_doubles(labelled, features))
    ready = indexer.transform(as_doubles(labelled, features)).select("sample_id", label, "label", *features)
    return *_split(ready, label, "sample_id", 0.25), indexer.labels


def _prepared(parts: Sequence[tuple[DataFrame, DataFrame]], features: Sequence[str], keep: Sequence[str] = ()) -> list[tuple[DataFrame, DataFrame]]:
    """Train and held rows of each fit as the preparation of its train part makes them; all models of a fit read the same files."""
    out = []
    for train, held in parts:
        ready = Pipeline(stages=preparation(features)).fit(train)
        held = held.withColumn("class_weight", F.lit(0.0))
        out.append(tuple(cut_lineage(ready.transform(part).select("label", "class_weight", "features", *keep)) for part in (train, held)))
    return out


def _fitted(parts: Sequence[tuple[DataFrame, DataFrame]], estimator, features: int, classes: int) -> list | None:
    """Models of all fits together, where there is a way for the estimator."""
    return linear.fit_linear(binned.all_rows(parts), estimator, features, classes) or binned.fit_cells(parts, estimator, features, classes)


def _scores(parts: Sequence[tuple[DataFrame, DataFrame]], estimator, features: int, classes: int) -> list[tuple[float, float]]:
    """Accuracy on the train and the held rows of each fit."""
    if found := _fitted(parts, estimator, features, classes):
        return [(m.train_accuracy, m.held_accuracy) for m in found]
    models = [(estimator.fit(train), train, held) for train, held in parts]
    return [(_accuracy(m.transform(train), "label"), _accuracy(m.transform(held), "label")) for m, train, held in models]


def compare_classifiers(labelled: DataFrame, label: str, features: Sequence[str], trees: int = 300, rounds: int = 200,
                        folds: int = 0, names: Sequence[str] | None = None) -> DataFrame:
    """Accuracy of logistic regression, forest and boosted trees; best first, ties by the usual rules."""
    models = classifiers(trees, rounds)
    train, test, labels = _labelled(labelled, label, features)
    parts = [(train, test)]
    if folds:
        dealt = cut_lineage(_even(stats.stratified_folds(train, label, "sample_id", folds), "sample_id", train.count()))
        parts += [(dealt.where(F.col("fold") != i), dealt.where(F.col("fold") == i)) for i in range(folds)]
    parts, rows = _prepared(parts, features), []
    for name in names or models:
        whole, *rest = _scores(parts, models[name], len(features), len(labels))
        held = [score for _, score in rest]
        rows.append((name, *whole, *((float(np.mean(held)), float(np.std(held))) if folds else (None, None))))
    return leaderboard(labelled.sparkSession.createDataFrame(
        rows, "model string, train_accuracy double, test_accuracy double, cv_mean double, cv_std double"))


def best_predictions(labelled: DataFrame, label: str, features: Sequence[str], board: DataFrame, trees: int = 300, rounds: int = 200) -> DataFrame:
    """(sample_id, actual, predicted) of the test part by the first model of ``board``."""
    best = board.first()["model"]
    train, test, labels = _labelled(labelled, label, features)
    estimator, parts = classifiers(trees, rounds)[best], _prepared([(train, test)], features, ["sample_id", label])
    found = _fitted(parts, estimator, len(features), len(labels))
    train, test = parts[0]
    scored = found[0].predict(test) if found else estimator.fit(train).transform(test)
    names = F.array(*[F.lit(n) for n in labels])
    return scored.select(
        "sample_id", F.col(label).alias("actual"), F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))


def report_rows(predictions: DataFrame) -> DataFrame:
    """Confusion counts and the report per class as rows: kind, label, other (predicted class or metric), value."""
    matrix = stats.confusion(predictions, "actual", "predicted")
    counts = matrix.select(F.lit("confusion").alias("kind"), F.col("actual").alias("label"), F.col("predicted").alias("other"), F.col("n").cast("double").alias("value"))
    report = stats.class_report(matrix)
    report = report.select("label", *[F.col(c).cast("double").alias(c) for c in ("precision", "recall", "f1", "support")]).unpivot(
        ["label"], ["precision", "recall", "f1", "support"], "other", "value")
    return counts.unionByName(report.select(F.lit("report").alias("kind"), "label", "other", "value"))


def metric_board(spark: SparkSession, model: str) -> DataFrame:
    """A board of one model that was chosen beforehand."""
    return spark.createDataFrame([(model, None, None, None, None)], "model string, train_accuracy double, test_accuracy double, cv_mean double, cv_std double")


def leaderboard(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("test_accuracy"), F.desc_nulls_last("cv_mean"), F.asc_nulls_last("cv_std"), "model")


def cluster_markers(z_scored: DataFrame, columns: Sequence[str], k: int = 4) -> DataFrame:
    """Samples grouped by their standardised markers."""
    # Training goes over the rows again and again; without files each pass would make the markers anew from the expression.
    z_scored = cut_lineage(z_scored)
    ready = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(z_scored)
    model = KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="cluster").fit(ready)
    return model.transform(ready).select("sample_id", *columns, "cluster")


#: Genes up to which the component analysis over gene columns is exact and in one pass.
PCA_COLUMNS = 2048


def sample_components(matrix: DataFrame, k: int = 2, columns: int = PCA_COLUMNS) -> DataFrame:
    """First k components of the samples over standardised genes.

    With few genes, component analysis over gene columns; with many, subspace iteration over blocks of the matrix,
    whatever the number of samples.
    """
    moments = matrix.groupBy("gene_symbol").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = matrix.join(moments, "gene_symbol").select(
        "gene_symbol", "sample_id",
        F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(F.lit(0.0)).alias("z"))
    names = [r[0] for r in moments.select("gene_symbol").orderBy("gene_symbol").limit(columns + 1).collect()]
    if len(names) > columns:
        scores, shares = leading_components(cut_lineage(z), "sample_id", "gene_symbol", "z", k)
        return scores.select("sample_id", *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(k)],
                             *[F.lit(float(shares[i])).alias(f"share{i + 1}") for i in range(k)])
    index = z.sparkSession.createDataFrame(list(enumerate(names)), "i int, gene_symbol string")
    packed = z.join(F.broadcast(index), "gene_symbol").groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "z"))).alias("c"))
    wide = packed.select("sample_id", array_to_vector(F.transform(
        F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.col("c")[i], F.lit(0.0)))).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(wide)
    shares = [float(x) for x in model.explainedVariance.toArray()]
    scores = model.transform(wide).withColumn("_pc", vector_to_array("pc"))
    return scores.select("sample_id", *[F.col("_pc")[i].alias(f"pc{i + 1}") for i in range(k)],
                         *[F.lit(shares[i]).alias(f"share{i + 1}") for i in range(k)])
