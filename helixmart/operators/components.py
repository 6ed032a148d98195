"""Leading components of a matrix that is wide on both sides: subspace iteration over dense blocks.

Rows and columns are dealt into blocks of about SIDE by hash, so a block is some megabytes whatever the matrix. An
iteration multiplies by the blocks and by their transposes; tall results are made orthonormal by a QR of each block and a
tree of QRs of the small triangles (TSQR), so nothing but small triangles meets the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from helixmart.session import cut_lineage

#: Rows and columns of a block, vectors iterated beyond the wanted ones, triangles that one task stacks.
SIDE, EXTRA, STACK = 1024, 10, 64
#: Iteration ends when the wanted variances change by less than this part, or after so many rounds.
CHANGE, ROUNDS = 1e-12, 200


def _dealt(names: DataFrame, name: str, block: str, at: str, size: str) -> DataFrame:
    """Block and place in it of each name; windows see one block."""
    blocks = -(-names.count() // SIDE)
    placed = names.select(name, F.pmod(F.xxhash64(name), F.lit(max(1, blocks))).cast("int").alias(block))
    inside = W.partitionBy(block)
    return cut_lineage(placed.select("*", (F.row_number().over(inside.orderBy(name)) - 1).alias(at), F.count("*").over(inside).cast("int").alias(size)))


def blocks_of(entries: DataFrame, row: str, column: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, places of the rows): blocks are (i, j, data) with dense row-major doubles; missing entries are 0, entries
    named twice add up."""
    rows = _dealt(entries.select(row).distinct(), row, "i", "r", "height")
    columns = _dealt(entries.select(column).distinct(), column, "j", "c", "width")
    placed = entries.join(rows, row).join(columns, column).select("i", "j", "r", "c", "height", "width", F.col(value).alias("v"))

    def fill(t: pa.Table) -> pa.Table:
        block = np.zeros((t["height"][0].as_py(), t["width"][0].as_py()))
        np.add.at(block, (t["r"].to_numpy(), t["c"].to_numpy()), t["v"].to_numpy())
        return pa.table({"i": t["i"][:1], "j": t["j"][:1], "height": t["height"][:1], "width": t["width"][:1], "data": pa.array([block.tobytes()], pa.binary())})

    return cut_lineage(placed.groupBy("i", "j").applyInArrow(fill, "i int, j int, height int, width int, data binary")), rows


def _product(blocks: DataFrame, tall: DataFrame, across: str, along: str, vectors: int) -> DataFrame:
    """(block number, data): the blocks (or their transposes) times ``tall``, whose rows lie along ``along``."""

    def multiply(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"]).reshape(r["height"], r["width"])
                part = (a if along == "j" else a.T) @ np.frombuffer(r["x"]).reshape(-1, vectors)
                yield pa.RecordBatch.from_arrays([pa.array([r[across]], pa.int32()), pa.array([r[along]], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                                                 ["n", "of", "x"])

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("of")
        total = sum(np.frombuffer(x.as_py()) for x in t["x"])
        return pa.table({"n": t["n"][:1], "of": t["of"][:1], "x": pa.array([total.tobytes()], pa.binary())})

    met = blocks.join(tall.withColumnRenamed("n", along), along).mapInArrow(multiply, "n int, of int, x binary")
    # A row of blocks is added in two steps, so that no task holds all of a wide matrix's.
    some = met.groupBy("n", F.floor(F.col("of") / STACK).alias("g")).applyInArrow(add, "n int, of int, x binary")
    return cut_lineage(some.groupBy("n").applyInArrow(add, "n int, of int, x binary").select("n", "x"))


def _triangle(tall: DataFrame, vectors: int) -> np.ndarray:
    """R of the QR of all rows of ``tall``: triangles of blocks, stacked by the STACK until few are left."""

    def factor(t: pa.Table) -> pa.Table:
        stacked = np.concatenate([np.frombuffer(x.as_py()).reshape(-1, vectors) for x in t.sort_by("n")["x"]])
        r = np.linalg.qr(stacked, mode="r")
        return pa.table({"n": pa.array([min(t["n"].to_pylist())], pa.int32()), "x": pa.array([r.tobytes()], pa.binary())})

    parts = tall.groupBy(F.col("n").alias("g")).applyInArrow(factor, "n int, x binary")
    number = tall.count()
    while number > STACK:
        number, step = -(-number // STACK), tall.count() // max(1, -(-number // STACK)) + 1
        parts = cut_lineage(parts.groupBy(F.floor(F.col("n") / step).alias("g")).applyInArrow(factor, "n int, x binary"))
    # At most STACK triangles of a few vectors each.
    rows = sorted(parts.collect(), key=lambda r: r["n"])
    return np.linalg.qr(np.concatenate([np.frombuffer(r["x"]).reshape(-1, vectors) for r in rows]), mode="r")


def _times(tall: DataFrame, small: np.ndarray, vectors: int) -> DataFrame:
    def turn(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["n"], pa.array([
                (np.frombuffer(x.as_py()).reshape(-1, vectors) @ small).tobytes() for x in batch["x"]], pa.binary())], ["n", "x"])

    return tall.mapInArrow(turn, "n int, x binary")


def leading_components(entries: DataFrame, row: str, column: str, value: str, k: int) -> tuple[DataFrame, list[float]]:
    """(row, pc: array of k scores) and the shares of the sum of squares, largest first, signs as they come."""
    blocks, rows = blocks_of(entries, row, column, value)
    sizes = blocks.select("j", "width").distinct()
    short = min(rows.count(), sizes.agg(F.sum("width")).first()[0])
    vectors = min(k + EXTRA, short)
    total = entries.groupBy(row, column).agg(F.sum(value).alias("v")).agg(F.sum(F.col("v") * F.col("v"))).first()[0]

    def start(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["j"], pa.array([
                np.random.default_rng([7, j]).normal(size=(w, vectors)).tobytes() for j, w in zip(batch["j"].to_pylist(), batch["width"].to_pylist(), strict=True)],
                pa.binary())], ["n", "x"])

    x = cut_lineage(sizes.mapInArrow(start, "n int, x binary"))
    before = np.zeros(k)
    for _ in range(ROUNDS):
        y = _product(blocks, x, "i", "j", vectors)
        q = _times(y, np.linalg.pinv(_triangle(y, vectors)), vectors)
        b = _product(blocks, q, "j", "i", vectors)
        r = _triangle(b, vectors)
        _, sigma, turn = np.linalg.svd(r)
        found = sigma[:k] ** 2
        if np.abs(found - before[: len(found)]).max() <= CHANGE * max(found.max(), np.finfo(float).tiny):
            break
        before = np.pad(found, (0, k - len(found)))
        x = _times(b, np.linalg.pinv(r), vectors)
    scores = _times(q, turn.T[:, :k] * sigma[:k], vectors)
    wide = min(k, vectors)

    def unpack(batches):
        for batch in batches:
            for n, data in zip(batch["n"].to_pylist(), batch["x"], strict=True):
                s = np.frombuffer(data.as_py()).reshape(-1, wide)
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(s), pa.int32()), pa.array(range(len(s)), pa.int32()), pa.array(list(s), pa.list_(pa.float64()))],
                                                 ["i", "r", "pc"])

    return rows.join(scores.mapInArrow(unpack, "i int, r int, pc array<double>"), ["i", "r"]).select(row, "pc"), (sigma[:k] ** 2 / total).tolist()
