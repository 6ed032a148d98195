"""Scoring a large table against a set of probe rows without a cross join.

Probes are written once as blocks in a shared file folder, neighbours in direction together. Every task of the large side
streams the blocks past its rows, so no copy of the large side travels and the plan is the same for any number of
probes. A block knows its centre and how far its probes lie from it; by the triangle inequality of angles, rows that no
probe of the block can score high enough for are left out before any product is taken. A task keeps the best rows (or
the count) per probe over all its batches and writes them once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helixmart.functions import constants as C
from helixmart.session import scratch_dir

#: Probes of a block, rows of the large side that pass the blocks together, and scores held at once (32 MB of doubles).
BLOCK_PROBES, ROWS_AT_ONCE, BLOCK_SCORES = 1024, 65_536, 4_000_000
#: Blocks that a task keeps open; more are read again for the next rows.
OPEN_BLOCKS = 64

Kernel = Callable[[pd.DataFrame, object, pd.DataFrame | None], pd.DataFrame]
Trim = Callable[[pd.DataFrame], pd.DataFrame]


def _blocks(folder: str, names: list[str], size: int, prepare) -> Iterator[object]:
    fs, path = FileSystem.from_uri(folder)
    for batch in ds.dataset(path, filesystem=fs, format="parquet").to_batches(columns=names, batch_size=size):
        if batch.num_rows:
            yield prepare(batch.to_pandas())


def probe_scan(corpus: DataFrame, probes: DataFrame, kernel: Kernel, schema: str, trim: Trim, per_row: bool = False,
               prepare=lambda block: block, order: Column | None = None, size: int = BLOCK_PROBES) -> DataFrame:
    """Apply ``kernel(corpus rows, probe block, what the block has so far)`` to every combination of both sides.

    ``trim`` reduces results to what can still matter: those of a block, over all rows of a task, or with ``per_row`` those
    of some rows, over all blocks. ``order`` puts neighbouring probes of a partition into one block.
    """
    folder = scratch_dir(corpus.sparkSession, "probe-blocks")
    (probes if order is None else probes.sortWithinPartitions(order)).write.parquet(folder)
    names = probes.columns

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, pd.DataFrame] = {}
        opened: list | None = []

        def all_blocks():
            nonlocal opened
            if opened:
                return opened
            if opened is None:
                return _blocks(folder, names, size, prepare)
            for block in _blocks(folder, names, size, prepare):
                opened.append(block)
                if len(opened) > OPEN_BLOCKS:
                    opened = None
                    return _blocks(folder, names, size, prepare)
            return opened

        def meet(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            step, found = max(1, BLOCK_SCORES // size), []
            for i, block in enumerate(all_blocks()):
                for at in range(0, len(rows), step):
                    part = kernel(rows.iloc[at : at + step], block, kept.get(i))
                    if per_row:
                        found.append(part)
                    elif len(part):
                        kept[i] = trim(pd.concat([kept[i], part], ignore_index=True) if i in kept else part)
            if found:
                yield trim(pd.concat(found, ignore_index=True))

        waiting: list[pd.DataFrame] = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= ROWS_AT_ONCE:
                yield from meet(pd.concat(waiting, ignore_index=True))
                waiting = []
        if waiting:
            yield from meet(pd.concat(waiting, ignore_index=True))
        yield from kept.values()

    return corpus.mapInPandas(scan, schema)


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


class VectorBlock:
    """Unit vectors of some probes, their centre, and the cosine and sine of the widest angle to it."""

    def __init__(self, block: pd.DataFrame, probe_id: str, vector: str):
        block = block.sort_values(probe_id, kind="stable")
        self.ids, self.unit = block[probe_id].to_numpy(), _unit(block[vector])
        centre = self.unit.sum(axis=0)
        length = np.linalg.norm(centre)
        self.centre = centre / length if length > 0 else None
        if self.centre is not None and (self.unit**2).sum(axis=1).min() > 0.5:
            self.cos = float(np.clip((self.unit @ self.centre).min(), -1, 1))
        else:  # vectors of length zero have no angle
            self.centre, self.cos = None, -1.0
        self.sin = float(np.sqrt(1 - self.cos**2))

    def ceiling(self, rows: np.ndarray) -> np.ndarray:
        """No probe's cosine with a (unit) row is above this: the angle to the centre less the widest angle."""
        if self.centre is None:
            return np.ones(len(rows))
        cos = np.clip(rows @ self.centre, -1, 1)
        bound = cos * self.cos + np.sqrt(1 - cos**2) * self.sin
        return np.where(cos >= self.cos, 1.0, bound) + 1e-7


def _direction(vector: str, places: int = 16) -> Column:
    """Signs of the first components: probes that point alike get equal beginnings."""
    return F.array_join(F.transform(F.slice(vector, 1, places), lambda x: F.when(x > 0, "1").otherwise("0")), "")


def _best_rows(scores: np.ndarray, ids: np.ndarray, keep: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best kept rows: score descending, id ascending."""
    at = np.flatnonzero(keep)
    if len(at) > k:
        at = at[np.lexsort((ids[at], -scores[at]))[:k]]
    return at


def _first_k(keys: list[str], ascending: list[bool], k: int) -> Trim:
    """The first k rows of each probe (the first key) in the order of the other keys."""
    return lambda found: found.sort_values(keys, ascending=ascending, kind="stable").groupby(keys[0], sort=False).head(k)


def _same_space(corpus: DataFrame, probes: DataFrame, column: str) -> DataFrame:
    """Refuse to compare vectors of different models where both sides name one."""
    if "model" in corpus.columns and "model" in probes.columns:
        names = [r[0] for r in probes.select("model").distinct().limit(2).collect()]
        if len(names) > 1:
            raise ValueError(f"probe vectors come from several models: {names}")
        return corpus.where(F.col("model").isin(names)) if names else corpus
    return corpus


def vector_top_k(corpus: DataFrame, probes: DataFrame, corpus_id: str, probe_id: str, vector: str = "embedding",
                 k: int = C.TOP_HITS, min_score: float = C.TEXT_MIN_SCORE, size: int = BLOCK_PROBES) -> DataFrame:
    """Per probe the k rows of highest cosine above ``min_score``: probe id, corpus id, score, place."""
    ids = dict(corpus.dtypes)[corpus_id], dict(probes.dtypes)[probe_id]

    def kernel(rows: pd.DataFrame, block: VectorBlock, kept: pd.DataFrame | None) -> pd.DataFrame:
        unit, floor = _unit(rows[vector]), min_score
        if kept is not None and len(kept) == k * len(block.ids):
            floor = max(floor, float(kept["score"].min()))
        near = np.flatnonzero(block.ceiling(unit) >= floor)
        scores = np.round(unit[near] @ block.unit.T, 9)
        names, out = rows[corpus_id].to_numpy()[near], []
        for j, probe in enumerate(block.ids):
            at = _best_rows(scores[:, j], names, scores[:, j] > min_score, k)
            if len(at):
                out.append((np.full(len(at), probe, block.ids.dtype), names[at], scores[at, j]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0)] * 3
        return pd.DataFrame(dict(zip([probe_id, corpus_id, "score"], columns, strict=True)))

    partial = probe_scan(
        _same_space(corpus, probes, vector).select(corpus_id, vector), probes.select(probe_id, vector), kernel,
        f"{probe_id} {ids[1]}, {corpus_id} {ids[0]}, score double",
        _first_k([probe_id, "score", corpus_id], [True, False, True], k), prepare=lambda b: VectorBlock(b, probe_id, vector),
        order=_direction(vector), size=size)
    best = W.partitionBy(probe_id).orderBy(F.desc("score"), F.asc(corpus_id))
    return partial.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def vector_best(scanned: DataFrame, probes: DataFrame, scanned_id: str, probe_id: str, vector: str = "embedding",
                min_score: float | None = None, size: int = BLOCK_PROBES) -> DataFrame:
    """Per scanned row its closest probe: scanned id, probe id, score; narrow, and every row meets all probes in its task."""

    def kernel(rows: pd.DataFrame, block: VectorBlock, _) -> pd.DataFrame:
        unit = _unit(rows[vector])
        at = np.flatnonzero(block.ceiling(unit) >= min_score) if min_score is not None else np.arange(len(rows))
        scores = np.round(unit[at] @ block.unit.T, 9)
        first = scores.argmax(axis=1) if len(at) else np.zeros(0, int)
        return pd.DataFrame({"_row": rows.index.to_numpy()[at], scanned_id: rows[scanned_id].to_numpy()[at], probe_id: block.ids[first],
                             "score": scores[np.arange(len(at)), first]})

    def nearest(found: pd.DataFrame) -> pd.DataFrame:
        ordered = found.sort_values(["_row", "score", probe_id], ascending=[True, False, True], kind="stable")
        return ordered.groupby("_row", sort=False).head(1).drop(columns="_row")

    ids = dict(scanned.dtypes)[scanned_id], dict(probes.dtypes)[probe_id]
    found = probe_scan(
        _same_space(scanned, probes, vector).select(scanned_id, vector), probes.select(probe_id, vector), kernel,
        f"{scanned_id} {ids[0]}, {probe_id} {ids[1]}, score double", nearest, per_row=True,
        prepare=lambda b: VectorBlock(b, probe_id, vector), order=_direction(vector), size=size)
    return found if min_score is None else found.where(F.col("score") > min_score)


def range_counts(corpus: DataFrame, probes: DataFrame, columns: list[str], probe_id: str, width: float, size: int = BLOCK_PROBES) -> DataFrame:
    """Per probe the corpus rows where ANY of the columns lies within ``width``."""

    def kernel(rows: pd.DataFrame, block: pd.DataFrame, _) -> pd.DataFrame:
        values, out = rows[columns].to_numpy(dtype=float), []
        for probe, centre in zip(block[probe_id], block[columns].to_numpy(dtype=float)):
            near = (values >= centre - width) & (values <= centre + width)
            out.append((probe, int(near.any(axis=1).sum())))
        return pd.DataFrame(out, columns=[probe_id, "n"])

    kind = dict(probes.dtypes)[probe_id]
    partial = probe_scan(corpus.select(*columns), probes.select(probe_id, *columns), kernel, f"{probe_id} {kind}, n bigint",
                         lambda found: found.groupby(probe_id, as_index=False, sort=False).sum(), size=size)
    return partial.groupBy(probe_id).agg(F.sum("n").alias("n"))


def nearest_rows(corpus: DataFrame, probes: DataFrame, columns: list[str], corpus_id: str, probe_id: str,
                 k: int = 5, carry: str | None = None, size: int = BLOCK_PROBES) -> DataFrame:
    """Per probe the k rows of smallest Euclidean distance over the columns, with one carried text column."""
    extra = [carry] if carry else []

    def kernel(rows: pd.DataFrame, block: pd.DataFrame, _) -> pd.DataFrame:
        values, ids, out = rows[columns].to_numpy(dtype=float), rows[corpus_id].to_numpy(), []
        for probe, centre in zip(block[probe_id], block[columns].to_numpy(dtype=float)):
            distance = np.round(np.sqrt(((values - centre) ** 2).sum(axis=1)), 9)
            at = _best_rows(-distance, ids, np.isfinite(distance), k)
            found = {probe_id: probe, corpus_id: ids[at], "distance": distance[at]}
            out.append(pd.DataFrame(found | {c: rows[c].to_numpy()[at] for c in extra}))
        return pd.concat(out)

    kinds = dict(corpus.dtypes)[corpus_id], dict(probes.dtypes)[probe_id]
    partial = probe_scan(
        corpus.select(corpus_id, *columns, *extra), probes.select(probe_id, *columns), kernel,
        ", ".join([f"{probe_id} {kinds[1]}, {corpus_id} {kinds[0]}, distance double", *[f"{c} string" for c in extra]]),
        _first_k([probe_id, "distance", corpus_id], [True, True, True], k), size=size)
    order = W.partitionBy(probe_id).orderBy("distance", corpus_id)
    return partial.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
