"""Toxicity scores by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and the first letters of each word, hashed to ``2**BITS`` features. The
machine adds to the linear weights a learned product for every pair of features, so that two harmless terms that
are toxic together (an insult with a mention of a group) are seen. Learning takes a bounded sample of the
labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixmart.llm.common import only, remembered, table, text_batches

BITS = 18
#: Labelled rows of each label that learning takes at most (the smallest by hash of doc_id).
SAMPLE_ROWS = 6000
THRESHOLD = 0.7
PREFIXES = (3, 4, 5)
_WORDS = re.compile(r"[^\W_]+").findall


class Terms(dict):
    """word -> bytes of its feature numbers (the word and its beginnings); emptied when full."""

    LIMIT = 300_000

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        terms = [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n)]
        found = np.array([xxhash.xxh3_64_intdigest(t) & self.mask for t in terms], np.int32).tobytes()
        self[word] = found
        return found


_TERMS: dict[int, Terms] = {}
remembered("terms", _TERMS.clear)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """The distinct feature numbers of a whole text; none for a null or empty text."""
    if not text:
        return np.empty(0, np.int32)
    terms = _TERMS.setdefault(bits, Terms(bits))
    words = set(_WORDS(text.lower()))
    return np.unique(np.frombuffer(b"".join(map(terms.__getitem__, words)), np.int32))


class FactorizationMachine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>), features being present or absent.

    Weights learn by FTRL-proximal steps with an L1 penalty: features without evidence keep weight zero, so a
    long clean text does not add up noise. For the same reason only features take part that tell the labels apart: by
    themselves, with a chi-squared statistic of ``min_chi2`` or more, or among the rows that hold some other feature, with
    ``pair_chi2`` or more, so that an interaction is learnt also where neither word means anything alone. Such pairs are
    sought among the ``pair_features`` most frequent features of no effect of their own; those with one take part anyway.
    Factors learn by AdaGrad with an L2 penalty.
    """

    def __init__(self, size: int, k: int = 4, l1: float = 0.1, l2: float = 0.05, alpha: float = 1.0, eta: float = 0.05,
                 decay: float = 1e-3, min_rows: int = 3, min_chi2: float = 12.0, pair_chi2: float = 40.0, pair_features: int = 2048, seed: int = 7):
        self.size, self.k, self.l1, self.l2, self.alpha, self.eta, self.decay = size, k, l1, l2, alpha, eta, decay
        self.min_rows, self.min_chi2, self.pair_chi2, self.pair_features, self.seed = min_rows, min_chi2, pair_chi2, pair_features, seed
        self.bias, self.w, self.v = 0.0, np.zeros(size), np.zeros((size, k))

    def margin(self, x: np.ndarray) -> float:
        v = self.v[x]
        s = v.sum(axis=0)
        return self.bias + self.w[x].sum() + 0.5 * (s @ s - (v * v).sum())

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30))))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 12) -> FactorizationMachine:
        rng = np.random.default_rng(self.seed)
        count = [np.zeros(self.size), np.zeros(self.size)]
        for x, y in zip(rows, labels, strict=True):
            count[int(y)][x] += 1
        total = [max(1, int((labels == y).sum())) for y in (0, 1)]
        # Pearson's chi-squared of each feature's 2 x 2 table; only features that tell the labels apart are learnt.
        seen = count[0] + count[1]
        gap = count[1] * (total[0] - count[0]) - count[0] * (total[1] - count[1])
        table = np.maximum(seen * (len(rows) - seen), 1) * total[0] * total[1]
        kept = (seen >= self.min_rows) & (len(rows) * gap * gap / table >= self.min_chi2)
        kept |= self._interacting(rows, labels, np.where(kept, 0, seen))
        rows = [x[kept[x]] for x in rows]
        self.v[kept] = rng.normal(0, 0.01, (int(kept.sum()), self.k))
        z, n, g_v = np.zeros(self.size), np.zeros(self.size), np.full((self.size, self.k), 1e-2)
        pos = weights[labels == 1].sum()
        neg = weights[labels == 0].sum()
        self.bias, g_b = float(np.log((pos + 1) / (neg + 1))), 1.0
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                x, y, weight = rows[i], labels[i], weights[i]
                v = self.v[x]
                s = v.sum(axis=0)
                m = self.bias + self.w[x].sum() + 0.5 * (s @ s - (v * v).sum())
                g = weight * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y)
                if abs(g) < 1e-4:
                    continue
                g_b += g * g
                self.bias -= 0.1 * g / np.sqrt(g_b)
                if not len(x):
                    continue
                sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / self.alpha
                z[x] += g - sigma * self.w[x]
                n[x] += g * g
                self.w[x] = np.where(np.abs(z[x]) <= self.l1, 0, -(z[x] - np.sign(z[x]) * self.l1) / (
                    (1 + np.sqrt(n[x])) / self.alpha + self.l2))
                grad = g * (s - v) + self.decay * v
                grad /= max(1.0, np.abs(grad).max())
                g_v[x] += grad * grad
                self.v[x] = v - self.eta * grad / np.sqrt(g_v[x])
        return self


    def _interacting(self, rows: list[np.ndarray], labels: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Features that tell the labels apart among the rows with some other feature: Pearson's chi-squared of the 2 x 2
        table of feature and label, for every ordered pair at once."""
        out = np.zeros(self.size, bool)
        common = np.argsort(-seen, kind="stable")[: self.pair_features]
        common = common[seen[common] >= self.min_rows]
        place = np.full(self.size, -1)
        place[common] = np.arange(len(common))
        both = [np.zeros((len(common), len(common)), np.float32) for _ in (0, 1)]
        for y in (0, 1):
            chosen = [x for x, label in zip(rows, labels, strict=True) if int(label) == y]
            for start in range(0, len(chosen), 1024):
                part = np.zeros((min(1024, len(chosen) - start), len(common)), np.float32)
                for i, x in enumerate(chosen[start : start + 1024]):
                    at = place[x]
                    part[i, at[at >= 0]] = 1
                both[y] += part.T @ part
        # Rows with feature a: n of each label; with a and b: both[y][a, b].
        n = [np.diag(b).astype(float) for b in both]
        for a in range(len(common)):
            pos, neg = n[1][a], n[0][a]
            with_b = both[1][a] + both[0][a]
            gap = both[1][a] * (neg - both[0][a]) - both[0][a] * (pos - both[1][a])
            table = pos * neg * with_b.astype(float) * (pos + neg - with_b)
            chi2 = np.divide((pos + neg) * gap.astype(float) ** 2, table, out=np.zeros(len(common)), where=table > 0)
            hit = chi2 >= self.pair_chi2
            if hit.any():
                # Both members are needed for their product.
                out[common[hit]] = True
                out[common[a]] = True
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, bits: int = BITS) -> tuple:
    """Features and labels of at most ``rows`` documents of each label, with weights that restore the labels' shares.

    Only (doc_id, toxic) pairs with a label 0 or 1 count; of several labels of one doc_id the largest holds. Of several
    rows of one doc_id the one whose text has the smallest hash is taken. The ids chosen are at most ``2 * rows``, so
    they may be broadcast, and as many rows reach the driver.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {int(r[0]): r[1] for r in known.groupBy("toxic").count().collect()}
    chosen = []
    for y in (0, 1):
        chosen += known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame([(r[0], int(r[1])) for r in chosen], "doc_id long, toxic int"))

    def read(batches):
        for doc_id, toxic, tie, text in text_batches(batches, ["doc_id", "toxic", "tie", "text"], "terms"):
            yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([toxic], pa.int32()), pa.array([tie], pa.int64()),
                                              pa.array([features(text, bits).tobytes()])], ["doc_id", "toxic", "tie", "x"])

    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text").join(few, "doc_id")
    one = met.mapInArrow(read, "doc_id long, toxic int, tie long, x binary").groupBy("doc_id", "toxic").agg(F.min(F.struct("tie", "x")).alias("row"))
    got = one.select("doc_id", "toxic", F.col("row.x").alias("x")).toPandas().sort_values(["doc_id", "x"], ignore_index=True)
    y = got["toxic"].to_numpy(float)
    share = {v: totals[v] / max(1, int((y == v).sum())) for v in totals}
    scale = sum(totals.values()) / max(1, len(y))
    return [np.frombuffer(b, np.int32) for b in got["x"]], y, np.array([share[v] / scale for v in y.astype(int)])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, bits: int = BITS) -> FactorizationMachine:
    """Without any labelled row the machine stays untrained and scores 0.5 everywhere."""
    x, y, weights = labelled_sample(docs, labels, rows, bits)
    machine = FactorizationMachine(1 << bits)
    return machine.fit(x, y, weights) if len(x) else machine


def score(docs: DataFrame, machine: FactorizationMachine, bits: int = BITS, name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole ``text`` in column ``name``; null and empty texts score the bias."""
    used = np.flatnonzero((machine.w != 0) | machine.v.any(axis=1)).astype(np.int32)
    # Bounded by 2**bits features, whatever the corpus.
    model = docs.sparkSession.sparkContext.broadcast((machine.bias, used, machine.w[used], machine.v[used]))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        only("terms")
        bias, ids, w, v = model.value
        own = FactorizationMachine.__new__(FactorizationMachine)
        place = np.full(1 << bits, -1, np.int32)
        place[ids] = np.arange(len(ids))
        own.bias, own.w, own.v = bias, w, v
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            at = place[features(text, bits)]
            out[i] = own.score(at[at >= 0])
        return pd.Series(out)

    return docs.withColumn(name, scored(F.col("text")))


def fold(doc_id) -> F.Column:
    """True for the held-out third: crc32 of the id's text mod 3 is 1. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(~fold(F.col("doc_id")))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
