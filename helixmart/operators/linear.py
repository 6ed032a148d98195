"""Logistic regression of each class against the rest, for all fits at once.

Without a penalty the best coefficients are one point, which Newton's method reaches in some ten passes over the rows; each pass
sums gradients and curvatures of all classes and fits, instead of one job per step, class and fit. Nothing but sums leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

#: Features up to which tasks hold the curvatures of all classes.
MAX_FEATURES = 64
#: Loss a unit of weight that a step must gain; Newton's steps square the error, so the next one would gain nothing.
TOLERANCE = 1e-10


def _with_one(x: pa.Array, k: int) -> np.ndarray:
    values = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return np.concatenate([values, np.ones((len(values), 1))], 1)


def _sums(x: np.ndarray, label: np.ndarray, weight: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """Per class: loss, gradient and curvature."""
    out = []
    for c, slope in enumerate(slopes):
        y, margin = (label == c).astype(float), x @ slope
        p = np.exp(-np.logaddexp(0.0, -margin))
        loss = (weight * (np.logaddexp(0.0, margin) - y * margin)).sum()
        out.append(np.concatenate([[loss], x.T @ (weight * (p - y)), ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()]))
    return np.array(out)


def _pass(rows: DataFrame, k: int, slopes: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            fit, label, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fit", "label", "class_weight"))
            x = _with_one(batch.column("x"), k)
            for f in np.unique(fit).tolist():
                if f in slopes:
                    at = fit == f
                    total[f] = total.get(f, 0.0) + _sums(x[at], label[at], weight[at], slopes[f])
        if total:
            yield pa.RecordBatch.from_pydict({"fit": pa.array(total, pa.int32()), "sums": pa.array([s.tobytes() for s in total.values()], pa.binary())})

    out: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(work, "fit int, sums binary").collect():
        s = np.frombuffer(r["sums"]).reshape(len(slopes[r["fit"]]), -1)
        out[r["fit"]] = out.get(r["fit"], 0.0) + s
    return out


def _slopes(rows: DataFrame, k: int, classes: int, weights: dict[int, np.ndarray], passes: int) -> dict[int, np.ndarray]:
    """Coefficients and intercept by fit and class."""
    best = {f: np.zeros((classes, k + 1)) for f in weights}
    tried = {f: b.copy() for f, b in best.items()}
    loss = {f: np.full(classes, np.inf) for f in weights}
    moving = {f: np.array([0 < w < weights[f].sum() for w in weights[f]]) for f in weights}
    step = {f: np.zeros((classes, k + 1)) for f in weights}
    for _ in range(passes):
        asked = {f: tried[f] for f in tried if moving[f].any()}
        if not asked:
            break
        for f, sums in _pass(rows, k, asked).items():
            for c in np.flatnonzero(moving[f]):
                now = sums[c, 0]
                if not now <= loss[f][c]:  # too far: half the way
                    step[f][c] /= 2
                    moving[f][c] = np.abs(step[f][c]).max() > 1e-12
                    tried[f][c] = best[f][c] + step[f][c]
                    continue
                gained, loss[f][c], best[f][c] = loss[f][c] - now, now, tried[f][c]
                moving[f][c] = gained > TOLERANCE * weights[f].sum()
                step[f][c] = -np.linalg.lstsq(sums[c, k + 2:].reshape(k + 1, k + 1), sums[c, 1:k + 2], rcond=1e-12)[0]
                tried[f][c] = best[f][c] + step[f][c]
    for f, w in weights.items():  # a class that has no rows, or all
        best[f][w <= 0, -1], best[f][w >= w.sum(), -1] = -np.inf, np.inf
    return best


def _chosen(x: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    return (x[:, :-1] @ slopes[:, :-1].T + slopes[:, -1]).argmax(1)


@dataclass
class LinearModel:
    slopes: np.ndarray
    train_accuracy: float
    held_accuracy: float

    def predict(self, held: DataFrame) -> DataFrame:
        """Adds the column prediction to rows, instead of their features."""
        slopes, k = self.slopes, self.slopes.shape[1] - 1
        rest = held.drop("features").columns

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _chosen(_with_one(batch.column("x"), k), slopes)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(found.astype(float))], [*rest, "prediction"])

        kinds = dict(held.dtypes)
        return held.select(vector_to_array("features").alias("x"), *rest).mapInArrow(
            score, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], "prediction double"]))


def fit_linear(rows: DataFrame, estimator, k: int, classes: int) -> list[LinearModel] | None:
    """A model per fit of ``rows`` (fit, held, label, class_weight, x); None for estimators that are not logistic regression of each
    class against the rest without a penalty."""
    if not (isinstance(estimator, OneVsRest) and isinstance(estimator.getClassifier(), LogisticRegression)):
        return None
    if estimator.getClassifier().getRegParam() or k > MAX_FEATURES:
        return None
    train, weights = rows.where(~F.col("held")).drop("held"), {}
    for r in train.groupBy("fit", "label").agg(F.sum("class_weight").alias("w")).collect():
        weights.setdefault(r["fit"], np.zeros(classes))[int(r["label"])] = r["w"]
    slopes = _slopes(train, k, classes, weights, estimator.getClassifier().getMaxIter())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fit", "label"))
            x, hit = _with_one(batch.column("x"), k), np.zeros(len(fit), bool)
            for f in np.unique(fit).tolist():
                at = fit == f
                hit[at] = _chosen(x[at], slopes[f]) == label[at]
            yield pa.RecordBatch.from_arrays([batch.column("fit"), batch.column("held"), pa.array(hit)], ["fit", "held", "hit"])

    hits = rows.mapInArrow(count, "fit int, held boolean, hit boolean").groupBy("fit", "held").agg(F.avg(F.col("hit").cast("int")).alias("share"))
    share = {(r["fit"], r["held"]): r["share"] for r in hits.collect()}
    return [LinearModel(slopes[f], share.get((f, False), 0.0), share.get((f, True), 0.0)) for f in sorted(slopes)]

