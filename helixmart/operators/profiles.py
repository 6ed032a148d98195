"""Every row against every other in a few numeric dimensions: nearest rows and range counts.

Equal points are one cell, so repeated values cost nothing. A k-d tree cuts the space into leaves of about LEAF cells,
small where rows are dense; it is built from a bounded sample, which decides how even the leaves are and never what is
found. Nearest rows are sought inside the own leaf first; a second round asks only leaves that the k-th distance reaches.
Range counts take whole nodes of the tree where all of a node is in range and leave out those where nothing is; what
is left, the leaves at the border, is tested 64 cells at once: per dimension a block's cells in order of it give one
bit set for every prefix, a range is the difference of two prefixes, and ranges are joined and counted as bits. Blocks
lie in shared files that tasks stream, so no copy of the corpus travels for a block of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Window as W, functions as F

from helixmart.session import cut_lineage, scratch_dir

#: Cells of a leaf where ranges are counted and where nearest rows are sought, levels of the tree at most (65,536 leaves;
#: beyond, leaves grow), and sampled cells per leaf.
LEAF, NEAR_LEAF, MAX_DEPTH, SAMPLE_PER_LEAF = 2048, 512, 16, 32
#: Cells of a block of bit sets, queries that stream the blocks together, and pairs of a query and a leaf held meanwhile.
BLOCK_CELLS, QUERIES_AT_ONCE, TESTS_AT_ONCE = 4096, 1 << 18, 1 << 24
#: Queries whose joined bit sets are held at once, 512 bytes each for a side of the dimensions.
JOINED_AT_ONCE = 1 << 15
#: Distances, and nodes of points, held at once by a task.
PAIRS_AT_ONCE, NODES_AT_ONCE = 2_000_000, 1 << 17


def _finite(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.abs(F.col(c).cast("double")) < float("inf"))
    return df.withColumns({c: F.col(c).cast("double") + 0.0 for c in columns})


class KdTree:
    """Cuts of a complete binary tree in heap order; a point at or below a cut goes left."""

    def __init__(self, dims: np.ndarray, cuts: np.ndarray, depth: int):
        self.dims, self.cuts, self.depth = dims, cuts, depth

    @classmethod
    def build(cls, points: np.ndarray, depth: int) -> KdTree:
        dims, cuts = np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
        parts = {1: points}
        for node in range(1, 1 << depth):
            p = parts.pop(node)
            if len(p):
                dims[node] = d = int(np.ptp(p, axis=0).argmax())
                cuts[node] = np.partition(p[:, d], (len(p) - 1) // 2)[(len(p) - 1) // 2]
            right = p[:, dims[node]] > cuts[node]
            if 2 * node < 1 << depth:
                parts[2 * node], parts[2 * node + 1] = p[~right], p[right]
        return cls(dims, cuts, depth)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dims[node]] > self.cuts[node])
        return node - (1 << self.depth)


class LeafBoxes:
    """What lies in the leaves: bounds and numbers of rows, summed up to the root. As large as the tree."""

    def __init__(self, rows: list, depth: int, width: int):
        n = 1 << depth
        self.depth = depth
        self.low, self.high, self.rows = np.full((2 * n, width), np.inf), np.full((2 * n, width), -np.inf), np.zeros(2 * n, np.int64)
        for r in rows:
            self.low[n + r["leaf"]], self.high[n + r["leaf"]], self.rows[n + r["leaf"]] = r["low"], r["high"], r["n"]
        for node in range(n - 1, 0, -1):
            a, b = 2 * node, 2 * node + 1
            self.low[node], self.high[node] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])
            self.rows[node] = self.rows[a] + self.rows[b]

    def sure_reach(self, points: np.ndarray, k: int, metric) -> np.ndarray:
        """A distance within which each point surely finds k rows: the far corner of the best node that holds so many."""
        node = np.ones(len(points), np.int64)
        best = np.full(len(points), np.inf)
        for _ in range(self.depth + 1):
            far = np.where(self.rows[node] >= k, metric.furthest(points, self.low[node], self.high[node]), np.inf)
            best = np.minimum(best, far)
            left, right = 2 * node, 2 * node + 1
            if left.max(initial=0) >= len(self.rows):
                break
            middle = (self.low + self.high) / 2

            def away(child):
                with np.errstate(invalid="ignore"):
                    d = ((points - middle[child]) ** 2).sum(axis=1)
                return np.where(self.rows[child] >= k, d, np.inf)

            node = np.where(away(right) < away(left), right, left)
        return best

    def reached(self, points: np.ndarray, radius: np.ndarray, metric) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(point, leaf) of the leaves with rows that may lie within each point's radius, piece by piece: at most
        NODES_AT_ONCE nodes are tested together, and half a piece waits per cut and level."""
        waiting = [(0, np.arange(len(points)), np.ones(len(points), np.int64))]
        while waiting:
            level, at, node = waiting.pop()
            if len(at) > NODES_AT_ONCE:
                half = len(at) // 2
                waiting += [(level, at[half:], node[half:]), (level, at[:half], node[:half])]
                continue
            near = (self.rows[node] > 0) & (metric.nearest(points[at], self.low[node], self.high[node]) <= radius[at])
            at, node = at[near], node[near]
            if level < self.depth and len(at):
                waiting.append((level + 1, np.repeat(at, 2), np.stack([2 * node, 2 * node + 1], axis=1).reshape(-1)))
            elif len(at):
                yield at, node - (1 << self.depth)

    def border(self, points: np.ndarray, reach: np.ndarray, any_of: bool, found: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Adds to ``found`` the rows of the nodes that lie in range of each point as a whole; yields the leaves left to test
        in ascending order, each with its points. Goes down one branch at a time, so a point is held once per level."""
        slack = 1e-9 * (1 + np.abs(points).max(initial=0))
        waiting = [(1, 0, np.arange(len(points), dtype=np.int32))]
        while waiting:
            node, level, at = waiting.pop()
            if not len(at) or not self.rows[node]:
                continue
            p, low, high = points[at], self.low[node], self.high[node]
            inside = np.maximum(np.abs(p - low), np.abs(high - p)) <= reach - slack
            outside = np.maximum(np.maximum(low - p, p - high), 0) > reach + slack
            inside, outside = (inside.any(axis=1), outside.all(axis=1)) if any_of else (inside.all(axis=1), outside.any(axis=1))
            found[at[inside]] += self.rows[node]
            at = at[~inside & ~outside]
            if level < self.depth:
                waiting += [(2 * node + 1, level + 1, at), (2 * node, level + 1, at)]
            elif len(at):
                yield node - (1 << self.depth), at


class Euclidean:
    """Straight distance, to 9 decimals."""

    def pairs(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        d = np.zeros((len(q), len(p)))
        for j in range(p.shape[1]):
            d += (p[None, :, j] - q[:, None, j]) ** 2
        return np.round(np.sqrt(d), 9)

    def nearest(self, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.sqrt((np.maximum(np.maximum(low - p, p - high), 0) ** 2).sum(axis=1)) - 1e-8

    def furthest(self, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.sqrt((np.maximum(np.abs(p - low), np.abs(high - p)) ** 2).sum(axis=1)) + 1e-8


class WithinRanges:
    """Sum of the differences of some dimensions (``counted``), among rows that lie within ``reach`` in each dimension."""

    def __init__(self, reach: list[float], counted: list[bool]):
        self.reach, self.counted = np.array(reach, float), np.array(counted)

    def pairs(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        d, out = np.zeros((len(q), len(p))), np.zeros((len(q), len(p)), bool)
        for j in range(p.shape[1]):
            gap = np.abs(p[None, :, j] - q[:, None, j])
            out |= gap > self.reach[j]
            if self.counted[j]:
                d += gap
        d[out] = np.inf
        return d

    def nearest(self, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        gap, slack = np.maximum(np.maximum(low - p, p - high), 0), 1e-9 * (1 + np.abs(p).max(initial=0))
        return np.where((gap > self.reach + slack).any(axis=1), np.inf, (gap * self.counted).sum(axis=1) - slack)

    def furthest(self, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        gap, slack = np.maximum(np.abs(p - low), np.abs(high - p)), 1e-9 * (1 + np.abs(p).max(initial=0))
        return np.where((gap > self.reach - slack).any(axis=1), np.inf, (gap * self.counted).sum(axis=1) + slack)


def _matrix(batch: pa.RecordBatch | pa.Table, columns: list[str]) -> np.ndarray:
    out = np.empty((batch.num_rows, len(columns)))
    for i, c in enumerate(columns):
        out[:, i] = batch[c].to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[c].to_numpy()
    return out


def kd_tree(cells: DataFrame, columns: list[str], leaf: int = LEAF) -> KdTree:
    """Tree over the distinct profiles ``cells``, from at most SAMPLE_PER_LEAF of them per leaf, chosen by hash."""
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(cells.count(), 1) / leaf))))
    if not depth:
        return KdTree(np.zeros(1, np.int64), np.zeros(1), 0)
    few = cells.select(*columns).orderBy(F.xxhash64(*columns)).limit(SAMPLE_PER_LEAF << depth).toPandas()
    return KdTree.build(few.to_numpy(dtype=float), depth)


def with_leaf(df: DataFrame, tree: KdTree, columns: list[str]) -> DataFrame:
    @F.pandas_udf("int")
    def leaf_of(*values):
        import pandas as pd

        return pd.Series(tree.leaf(np.stack([v.to_numpy(dtype=float) for v in values], axis=1)))

    return df.withColumn("leaf", leaf_of(*columns))


# -- nearest -----------------------------------------------------------------------------------

def _best(queries: np.ndarray, points: np.ndarray, order: np.ndarray, k: int, metric) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, point, distance) of the k nearest points of each query; equal distances by ``order``."""
    step = max(1, PAIRS_AT_ONCE // max(1, len(points)))
    for start in range(0, len(queries), step):
        d = metric.pairs(queries[start : start + step], points)
        near = np.isfinite(d)
        if len(points) > k:
            # All at the k-th distance stay, so that ties are settled by order and not by chance.
            near &= d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        at, point = np.nonzero(near)
        by = np.lexsort((order[point], d[at, point], at))
        at, point = at[by], point[by]
        first = np.searchsorted(at, at)
        keep = np.arange(len(at)) - first < k
        yield at[keep] + start, point[keep], d[at[keep], point[keep]]


def first_of_cells(rows: DataFrame, columns: list[str], row_id: str, k: int) -> DataFrame:
    """The first k rows of each point: of equal points no others can be among the k nearest. The limit also runs before
    the shuffle, so a point that many rows share fills no task."""
    first = W.partitionBy(*columns).orderBy(row_id)
    return rows.withColumn("_p", F.row_number().over(first)).where(F.col("_p") <= k).drop("_p")


def nearest_of_all(queries: DataFrame, corpus: DataFrame, columns: list[str], corpus_id: str = "sample_id", k: int = 5,
                   carry: Sequence[str] = (), metric=None, leaf: int = NEAR_LEAF) -> DataFrame:
    """The k corpus rows of smallest distance (Euclidean unless a metric is given) for every distinct point of ``queries``:
    the point's columns, distance, corpus id, carried columns and place; ties go to the smaller id. Rows with a missing
    or non-finite coordinate take no part."""
    metric = metric or Euclidean()
    extra = list(carry)
    corpus = _finite(corpus.select(corpus_id, *columns, *extra), columns)
    wanted = _finite(queries.select(*columns), columns).distinct()
    cells = cut_lineage(first_of_cells(corpus, columns, corpus_id, k))
    tree = kd_tree(cells, columns, leaf)
    cells, wanted = with_leaf(cells, tree, columns), with_leaf(wanted, tree, columns)
    boxes = cells.groupBy("leaf").agg(
        F.array(*[F.min(c) for c in columns]).alias("low"), F.array(*[F.max(c) for c in columns]).alias("high"), F.count("*").alias("n"))
    # At most one row per leaf of the tree.
    shared = cells.sparkSession.sparkContext.broadcast(LeafBoxes(boxes.collect(), tree.depth, len(columns)))
    kinds = dict(cells.dtypes)
    found_schema = ", ".join([*[f"{c} double" for c in columns], "distance double", f"{corpus_id} {kinds[corpus_id]}", *[f"{c} {kinds[c]}" for c in extra]])

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        q, p = _matrix(asked, columns), _matrix(rows, columns)
        ids = rows[corpus_id].to_numpy() if rows.num_rows else np.zeros(0)
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        at, point, distance = (np.concatenate(x) for x in zip(*_best(q, p, rank, k, metric), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), strict=True))
        data = {c: q[at, i] for i, c in enumerate(columns)} | {"distance": distance}
        taken = rows.select([corpus_id, *extra]).take(pa.array(point))
        return pa.table({**data, **{c: taken[c] for c in [corpus_id, *extra]}})

    def meeting(asked: DataFrame) -> DataFrame:
        return asked.groupBy("leaf").cogroup(cells.groupBy("leaf")).applyInArrow(meet, found_schema)

    own = cut_lineage(meeting(wanted))
    reach = own.groupBy(*columns).agg(F.max("distance").alias("_far"), F.count("*").alias("_n"))
    asked = wanted.join(reach, columns, "left")

    def others(batches):
        boxes = shared.value
        for batch in batches:
            p, n = _matrix(batch, columns), batch["_n"].fill_null(0).to_numpy(zero_copy_only=False)
            far = np.where(n >= k, batch["_far"].fill_null(np.inf).to_numpy(zero_copy_only=False), np.inf)
            short = np.isinf(far)
            if short.any():
                far[short] = boxes.sure_reach(p[short], k, metric)
            own_leaf = batch["leaf"].to_numpy(zero_copy_only=False)
            for at, there in boxes.reached(p, far, metric):
                new = there != own_leaf[at]
                at, there = at[new], there[new]
                yield pa.RecordBatch.from_arrays([*[pa.array(p[at, i]) for i in range(len(columns))], pa.array(there.astype(np.int32))], [*columns, "leaf"])

    further = asked.select(*columns, "leaf", "_far", "_n").mapInArrow(others, ", ".join([*[f"{c} double" for c in columns], "leaf int"]))
    order = W.partitionBy(*columns).orderBy("distance", corpus_id)
    return own.unionByName(meeting(further)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


# -- counts ------------------------------------------------------------------------------------

def _write_blocks(cells: DataFrame, columns: list[str], folder: str) -> None:
    """Cells (leaf, columns, n) as rows of up to BLOCK_CELLS of one leaf; cells of one row lie apart from repeated ones."""

    def pack(batches):
        waiting: list[tuple] = []

        def flush():
            p, n = (np.concatenate(x) for x in list(zip(*waiting, strict=True))[1:])
            for some in (n == 1, n > 1):
                at = np.flatnonzero(some)
                for start in range(0, len(at), BLOCK_CELLS):
                    part = at[start : start + BLOCK_CELLS]
                    yield pa.RecordBatch.from_arrays([pa.array([waiting[0][0]], pa.int32()), pa.array([p[part].astype("<f8").tobytes()], pa.binary()),
                                                      pa.array([n[part].astype("<i8").tobytes()], pa.binary())], ["leaf", "points", "counts"])
            waiting.clear()

        for batch in batches:
            p, n, leaf = _matrix(batch, columns), batch["n"].to_numpy(), batch["leaf"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if start < end:
                    if waiting and (waiting[0][0] != leaf[start] or sum(len(w[1]) for w in waiting) >= 8 * BLOCK_CELLS):
                        yield from flush()
                    waiting.append((int(leaf[start]), p[start:end], n[start:end]))
        if waiting:
            yield from flush()

    dealt = cells.repartitionByRange("leaf", *columns).sortWithinPartitions("leaf", *columns)
    dealt.select("leaf", *columns, "n").mapInArrow(pack, "leaf int, points binary, counts binary").write.parquet(folder)


def _read_blocks(folder: str, first: int, last: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The blocks of leaves ``first`` to ``last``; files lie by ranges of leaves, and their statistics rule most of them out."""
    fs, path = FileSystem.from_uri(folder)
    wanted = (ds.field("leaf") >= first) & (ds.field("leaf") <= last)
    for batch in ds.dataset(path, filesystem=fs, format="parquet").to_batches(filter=wanted, batch_size=16):
        for leaf, points, counts in zip(batch["leaf"], batch["points"], batch["counts"], strict=True):
            yield leaf.as_py(), np.frombuffer(points.as_py(), "<f8").reshape(-1, width), np.frombuffer(counts.as_py(), "<i8")


def _sides(q: np.ndarray) -> list[tuple[range, np.ndarray, np.ndarray]]:
    """The dimensions in two parts (one, where there are only two): the part's different values, and those of each query."""
    width = q.shape[1]
    cuts = [0, width // 2, width] if width > 2 else [0, width]
    parts = [range(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [(part, *np.unique(q[:, part.start : part.stop], axis=0, return_inverse=True)) for part in parts]


def _in_ranges(sides: list, some: np.ndarray, points: np.ndarray, counts: np.ndarray, reach: np.ndarray, any_of: bool) -> np.ndarray:
    """For each query of ``some`` the summed counts of the points within ``reach`` in any, or in every dimension. Ranges of
    a side are joined once for all queries of equal values there."""
    n, words, out = len(points), -(-len(points) // 64), np.zeros(len(some), np.int64)
    ranked, sets = [], []
    for j in range(points.shape[1]):
        order = np.argsort(points[:, j], kind="stable")
        ranked.append(points[order, j])
        prefix = np.zeros((n + 1, words), np.uint64)
        prefix[np.arange(1, n + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
        sets.append(np.bitwise_or.accumulate(prefix, axis=0))
    planes = []
    for bit in range(int(counts.max()).bit_length()):
        held = np.zeros(words * 64, bool)
        held[:n] = (counts >> bit) & 1
        planes.append(np.packbits(held, bitorder="little").view("<u8"))
    joint = np.bitwise_or if any_of else np.bitwise_and
    for first in range(0, len(some), JOINED_AT_ONCE):
        part, met = some[first : first + JOINED_AT_ONCE], []
        for dims, values, code in sides:
            mine = code[part]
            used = np.zeros(len(values), bool)
            used[mine] = True
            v, bits = values[used], None
            for i, j in enumerate(dims):
                lo, hi = np.searchsorted(ranked[j], v[:, i] - reach[j], "left"), np.searchsorted(ranked[j], v[:, i] + reach[j], "right")
                own = sets[j][hi]
                own ^= sets[j][lo]
                bits = own if bits is None else joint(bits, own, out=bits)
            met.append((bits, (np.cumsum(used) - 1)[mine]))
        for start in range(0, len(part), 4096):
            at, joined = slice(start, start + 4096), None
            for bits, place in met:
                own = bits[place[at]]
                joined = own if joined is None else joint(joined, own, out=joined)
            for bit, plane in enumerate(planes):
                out[first + start : first + start + len(joined)] += np.bitwise_count(joined & plane).sum(axis=1, dtype=np.int64) << bit
    return out


def counts_of_all(queries: DataFrame, corpus: DataFrame, reach: dict[str, float], any_of: bool = False, leaf: int = LEAF) -> DataFrame:
    """For every distinct point of ``queries`` the corpus rows within ``reach`` (column -> distance) in every column, or in
    any of them: the columns and n. Rows with a missing or non-finite coordinate take no part."""
    columns, width = list(reach), np.array(list(reach.values()), float)
    cells = cut_lineage(_finite(corpus.select(*columns), columns).groupBy(*columns).agg(F.count("*").alias("n")))
    tree = kd_tree(cells, columns, leaf)
    placed = with_leaf(cells, tree, columns)
    folder = scratch_dir(cells.sparkSession, "point-blocks")
    _write_blocks(placed, columns, folder)
    boxes = placed.groupBy("leaf").agg(
        F.array(*[F.min(c) for c in columns]).alias("low"), F.array(*[F.max(c) for c in columns]).alias("high"), F.sum("n").alias("n"))
    # At most one row per leaf of the tree.
    shared = cells.sparkSession.sparkContext.broadcast(LeafBoxes(boxes.collect(), tree.depth, len(columns)))
    wanted = with_leaf(_finite(queries.select(*columns), columns).distinct(), tree, columns)

    def count(batches):
        waiting: list[np.ndarray] = []

        def answer():
            q = np.concatenate(waiting)
            waiting.clear()
            n, asked, sides = np.zeros(len(q), np.int64), {}, _sides(q)

            def test():
                if asked:
                    for there, points, counts in _read_blocks(folder, min(asked), max(asked), len(columns)):
                        if there in asked:
                            some = asked[there]
                            n[some] += _in_ranges(sides, some, points, counts, width, any_of)
                asked.clear()

            for there, some in shared.value.border(q, width, any_of, n):
                asked[there] = some
                if sum(map(len, asked.values())) >= TESTS_AT_ONCE:
                    test()
            test()
            return pa.RecordBatch.from_arrays([*[pa.array(q[:, i]) for i in range(len(columns))], pa.array(n)], [*columns, "n"])

        for batch in batches:
            waiting.append(_matrix(batch, columns))
            if sum(map(len, waiting)) >= QUERIES_AT_ONCE:
                yield answer()
        if sum(map(len, waiting)):
            yield answer()

    # A row is little to send and much to count, so the number of tasks must not come from the bytes. Each makes the bit
    # sets for itself, so there are not many more tasks than cores.
    return wanted.repartitionByRange(2 * cells.sparkSession.sparkContext.defaultParallelism, "leaf", *columns).select(*columns).mapInArrow(count, ", ".join([*[f"{c} double" for c in columns], "n long"]))
