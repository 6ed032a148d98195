"""Exact nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are dealt over a grid of tiles. In a tile, products of int8 codes give every inner product
up to a proven error; only candidates whose upper bound reaches the k-th largest lower bound of their query
are computed again in double precision. Each tile leaves k rows per query, and a heap per query merges them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixmart.llm.common import stored, table

K, QUERY_STEP = 20, 20
#: Vectors of a tile's side.
TILE_QUERIES, TILE_VECTORS = 512, 8192


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the step of each row, and the length of what rounding took from it (rounded up)."""
    step = np.abs(v).max(axis=1) / 127
    step[step == 0] = 1  # values so small that the step underflows: the rest then holds them all
    codes = np.clip(np.rint(v / step[:, None]), -127, 127)
    rest = np.linalg.norm(v - codes * step[:, None], axis=1) * (1 + 1e-12)
    return codes.astype(np.int8), step, rest


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in the order of the components."""
    return np.cumsum(a * b, axis=1)[:, -1]


def tile_nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """For each query the k best candidates of the tile: index of the query, vec_id, score.

    Equal candidate vectors are scored once; of each only the k + 1 smallest ids can be among the k nearest.
    """
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    _, first, group = np.unique(c.view(f"V{c.dtype.itemsize * c.shape[1]}").ravel(), return_index=True, return_inverse=True)
    distinct = c[first]
    members = np.argsort(group, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(group))])
    sizes = np.minimum(np.diff(starts), k + 1)
    q8, q_step, q_rest = quantised(q)
    c8, c_step, c_rest = quantised(distinct)
    q_len = np.linalg.norm(q, axis=1) * (1 + 1e-12)
    c_len = np.linalg.norm(distinct, axis=1) * (1 + 1e-12)
    # |qc - q'c'| <= |q - q'||c| + |q'||c - c'|, and |q'| <= |q| + |q - q'|; the last term covers float sums.
    near = (q8.astype(np.float32) @ c8.astype(np.float32).T).astype(np.float64)  # exact: below 2**24 up to 1040 dimensions
    if q.shape[1] > 1000:
        near = q8.astype(np.float64) @ c8.astype(np.float64).T
    near *= q_step[:, None] * c_step
    slack = q_rest[:, None] * c_len + (q_len + q_rest)[:, None] * c_rest + 1e-12 * q_len[:, None] * c_len
    low, high = near - slack, near + slack
    out = [], [], []
    for i in range(len(q)):
        # The query's own row may be among the candidates, so one more is kept for it.
        kth = np.partition(np.repeat(low[i], sizes), -(k + 1))[-(k + 1)] if sizes.sum() > k else -np.inf
        at = np.flatnonzero(high[i] >= kth)
        score = inner(distinct[at], q[i])
        rows = [members[starts[g] : starts[g] + sizes[g]] for g in at.tolist()]
        ids = c_ids[np.concatenate(rows)]
        scores = np.repeat(score, sizes[at])
        other = ids != q_ids[i]
        ids, scores = ids[other], scores[other]
        best = np.lexsort((ids, -scores))[:k]
        out[0].append(np.full(len(best), i))
        out[1].append(ids[best])
        out[2].append(scores[best])
    return tuple(np.concatenate(x) if x else np.empty(0) for x in out)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k candidates of largest inner product, ties to the
    smaller vec_id; all candidates where there are fewer.

    Both inputs hold (vec_id, embedding). Rows with a null id, and vectors that are null, empty, all zero or hold
    a null or non-finite component take no part. Vectors of another length than the query's have no inner
    product with it. Rows with the query's vec_id are its own. Every row is a candidate, so equal rows are found as
    often as they stand there; a vec_id asks once, with its first vector.
    """
    schema = "dim int, query_id long, vec_id long, score double"
    shape = ["dim", "vec_id", "embedding"]

    def side(df: DataFrame) -> DataFrame:
        v = df.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"),
                                                  F.col("embedding").cast("array<double>").alias("embedding"))
        return v.where(usable(F.col("embedding"))).withColumn("dim", F.size("embedding")).select(*shape)

    asked = stored(side(queries).groupBy("vec_id").agg(F.min(F.struct("dim", "embedding")).alias("v")).select(
        F.col("v.dim").alias("dim"), "vec_id", F.col("v.embedding").alias("embedding")))
    # Equal rows meet before they are dealt out; of more than k equal ones, k can be among the nearest.
    counted = side(vectors).groupBy(*shape).agg(F.count("*").alias("n"))
    given = stored(counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k))))).select(*shape))
    rows, columns = max(1, -(-asked.count() // TILE_QUERIES)), max(1, -(-given.count() // TILE_VECTORS))
    # Every query block meets every candidate block once; a row is copied to the blocks of the other side only.
    q = asked.withColumn("i", F.pmod(F.xxhash64("vec_id"), F.lit(rows)).cast("int")).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    c = given.withColumn("j", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(columns)).cast("int")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def matrix(t):
        flat = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return t["vec_id"].to_numpy(), np.ascontiguousarray(flat.reshape(t.num_rows, -1))

    def tile(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"dim": pa.array([], pa.int32()), "query_id": pa.array([], pa.int64()),
                             "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q_ids, qv = matrix(left)
        c_ids, cv = matrix(right)
        parts = [tile_nearest(q_ids[a : a + 128], qv[a : a + 128], c_ids, cv, k) for a in range(0, len(q_ids), 128)]
        row = np.concatenate([p[0] + 128 * n for n, p in enumerate(parts)]).astype(np.int64)
        dim = np.full(len(row), qv.shape[1], np.int32)
        return pa.table({"dim": dim, "query_id": q_ids[row], "vec_id": np.concatenate([p[1] for p in parts]).astype(np.int64),
                         "score": np.concatenate([p[2] for p in parts]).astype(np.float64)})

    tiles = q.groupBy("dim", "i", "j").cogroup(c.groupBy("dim", "i", "j")).applyInArrow(tile, schema)

    def merge(t):
        """A heap per query over at most k rows from each tile."""
        best: dict[int, list] = {}
        for query, vec, score in zip(t["query_id"].to_pylist(), t["vec_id"].to_pylist(), t["score"].to_pylist(), strict=True):
            heap, item = best.setdefault(query, []), (score, -vec)
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        out = [(query, r, -v, s) for query, heap in best.items() for r, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = (("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64()))
        return pa.table({n: pa.array(c, kind) for (n, kind), c in zip(kinds, cols, strict=True)})

    blocks = max(1, rows * 2)
    keyed = tiles.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(blocks)))
    return keyed.groupBy("block").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op7_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


def nearest_sql() -> str:
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
             AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % {QUERY_STEP} = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
