"""Trained forests as SQL functions: a portable bundle, loaded once per worker, scored in Arrow batches."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.ml import PipelineModel
from pyspark.ml.feature import ImputerModel, StandardScalerModel, StringIndexerModel
from pyspark.sql import SparkSession, functions as F

from helixmart.functions import constants as C

RISK_RESULT = "risk_score double, risk_level string, confidence double, predicted_class int"
SUBTYPE_RESULT = "predicted_subtype string, confidence double, probabilities map<string,double>"


def export_bundle(model: PipelineModel, folder: str, features: Sequence[str]) -> None:
    """Write what scoring needs into one file below ``folder``, which all executors share: fill values, scaling, the
    forest's nodes as arrays, class names. As large as the model, whatever it was trained on."""
    stages = {type(s): s for s in model.stages}
    forest = model.stages[-1]
    spark = SparkSession.active()
    forest.write().overwrite().save(f"{folder}/forest")
    nodes = spark.read.parquet(f"{folder}/forest/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    index = {(n["treeID"], n["id"]): i for i, n in enumerate(nodes)}
    votes = np.array([n["impurityStats"] for n in nodes], float)
    total = votes.sum(axis=1, keepdims=True)
    surrogate = stages[ImputerModel].surrogateDF.first()
    filled = [f for f in stages[ImputerModel].getInputCols()]
    scaler = stages[StandardScalerModel]
    about = {"features": list(features), "labels": list(stages[StringIndexerModel].labels) if StringIndexerModel in stages else None}
    out = io.BytesIO()
    np.savez(
        out, about=np.frombuffer(json.dumps(about).encode(), np.uint8),
        fill=np.array([surrogate[f] for f in filled], float), mean=scaler.mean.toArray(), std=scaler.std.toArray(),
        feature=np.array([n["split"]["featureIndex"] for n in nodes], np.int64),
        cut=np.array([(n["split"]["leftCategoriesOrThreshold"] or [0.0])[0] for n in nodes], float),
        left=np.array([index.get((n["treeID"], n["leftChild"]), -1) for n in nodes], np.int64),
        right=np.array([index.get((n["treeID"], n["rightChild"]), -1) for n in nodes], np.int64),
        votes=np.divide(votes, total, out=np.zeros_like(votes), where=total != 0),
        roots=np.array([i for (_, node), i in index.items() if node == 0], np.int64))
    fs, path = FileSystem.from_uri(folder)
    with fs.open_output_stream(f"{path}/scoring.npz") as f:
        f.write(out.getvalue())


class Forest:
    """Scores rows of features; missing ones take the fill value."""

    _loaded: dict[str, Forest] = {}

    def __init__(self, data: bytes):
        a = dict(np.load(io.BytesIO(data)))
        about = json.loads(a["about"].tobytes())
        self.features, self.labels = about["features"], about["labels"]
        self.fill, self.mean, self.std = a["fill"], a["mean"], a["std"]
        self.feature, self.cut, self.left, self.right, self.votes, self.roots = (a[k] for k in ("feature", "cut", "left", "right", "votes", "roots"))

    @classmethod
    def load(cls, folder: str) -> Forest:
        """The worker's copy; the file is read once per worker and bundle, and two bundles are kept at most."""
        if folder not in cls._loaded:
            if len(cls._loaded) >= 2:
                cls._loaded.clear()
            fs, path = FileSystem.from_uri(folder)
            with fs.open_input_file(f"{path}/scoring.npz") as f:
                cls._loaded[folder] = cls(f.read())
        return cls._loaded[folder]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), self.fill, x)
        x = np.where(self.std != 0, (x - self.mean) / np.where(self.std != 0, self.std, 1), 0.0)
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while (inner := self.left[node] >= 0).any():
            goes = x[rows, self.feature[node]] <= self.cut[node]
            node = np.where(inner, np.where(goes, self.left[node], self.right[node]), node)
        raw = self.votes[node].sum(axis=1)
        return raw / raw.sum(axis=1, keepdims=True)


def _matrix(columns: Sequence[pd.Series], names: Sequence[str]) -> np.ndarray:
    out = np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns], axis=1)
    for j, name in enumerate(names):
        if name.startswith("is_"):  # missing flags count as 0
            out[np.isnan(out[:, j]), j] = 0.0
    return out


def _level(score: np.ndarray, profile: str) -> np.ndarray:
    out = np.full(len(score), C.RISK_REST[profile], object)
    for _, cut, label in reversed(C.RISK_CUTS[profile]):
        out[score >= cut] = label
    return out


def register_risk(spark: SparkSession, folder: str, name: str = "predict_risk", profile: str = "warehouse"):
    """SQL function over the risk features in their order: score, level, confidence, class. Also returned as a column
    function."""

    @F.pandas_udf(RISK_RESULT)
    def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        forest = Forest.load(folder)
        for columns in batches:
            p = forest.probabilities(_matrix(columns, forest.features))
            at = p.argmax(axis=1)
            yield pd.DataFrame({"risk_score": p[:, 1] * 100, "risk_level": _level(p[:, 1] * 100, profile),
                                "confidence": p[np.arange(len(p)), at], "predicted_class": at.astype(np.int32)})

    spark.udf.register(name, predict)
    return predict


def register_subtype(spark: SparkSession, folder: str, name: str = "predict_subtype"):
    """SQL function over the subtype features in their order: label, confidence, class -> probability."""

    @F.pandas_udf(SUBTYPE_RESULT)
    def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        forest = Forest.load(folder)
        for columns in batches:
            p = forest.probabilities(_matrix(columns, forest.features))
            at = p.argmax(axis=1)
            yield pd.DataFrame({"predicted_subtype": np.array(forest.labels, object)[at], "confidence": p[np.arange(len(p)), at],
                                "probabilities": [dict(zip(forest.labels, row, strict=True)) for row in p.tolist()]})

    spark.udf.register(name, predict)
    return predict
