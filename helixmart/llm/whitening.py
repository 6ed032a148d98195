"""Whitening of embeddings along the leading components, found by spectrum slicing.

Spark sums the vectors, then the products of centred vectors, in one row per matrix row and task. Each component is a
task of its own: the number of negative pivots of an LDL' factorisation of the shifted covariance is the number of
eigenvalues below the shift (Sylvester), so bisection on these counts closes in on the k-th largest eigenvalue until
no other is near; Rayleigh quotient iteration then converges cubically, and two more counts, just above and just below
the result, certify that it is the k-th. Eigenvalues closer together than double precision can tell apart are solved as
one group: each member starts orthogonal to those before it and stays so, in every task alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixmart.llm.common import table

COMPONENTS = 32
#: Fixed-point form of an entry: ``floor(SCALE * c) + SHIFT``, kept within +-LIMIT.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 53
#: Eigenvalues nearer than this part of the largest are one group; smaller than this part of the trace, they are zero.
TOGETHER, ZERO = 1e-9, 1e-12


def fixed_point(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of whole numbers; entries that a shorter vector lacks read as 0.0."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    full = np.zeros((len(lengths), width))
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    full[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(starts, lengths)] = flat
    return np.clip(np.floor(full * SCALE), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding is not null and holds neither null nor non-finite entries."""
    good = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("embedding").isNotNull() & good)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum per dimension."""

    def add(batches):
        n, sums = 0, []
        for batch in batches:
            column = batch["embedding"]
            width = max(column.value_lengths().to_pylist(), default=0)
            x = fixed_point(column, width) - SHIFT
            sums += [0] * (width - len(sums))
            big = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
            for j, s in enumerate(x.sum(axis=0).tolist() if big * len(x) < 1 << 62 else x.astype(object).sum(axis=0)):
                sums[j] += s
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(len(sums))], pa.int32()), pa.array([str(n), *map(str, sums)])], ["dim", "total"])

    parts = rows.mapInArrow(add, "dim int, total string").withColumn("total", F.col("total").cast("decimal(38,0)"))
    # One row per dimension.
    found = {r["dim"]: int(r["total"]) for r in parts.groupBy("dim").agg(F.sum("total").alias("total")).collect()}
    n = found.get(-1, 0)
    return n, [found[j] + n * SHIFT for j in range(len(found) - 1)]


def _products(rows: DataFrame, width: int, form, schema_name: str) -> np.ndarray:
    """Sum over all rows of the outer products of ``form(batch)``: each task sends one row per matrix row; a group adds
    that row of at most 256 tasks, then the groups' sums, always in the order of tasks."""

    def multiply(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                y = form(batch.slice(start, 4096))
                total += y.T @ y
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                         ["part", "dim", schema_name])

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        m = np.stack(t[schema_name].to_numpy())
        return pa.table({"part": t["part"][:1], "dim": t["dim"][:1], schema_name: pa.array([m.sum(axis=0)], pa.list_(pa.float64()))})

    schema = f"part int, dim int, {schema_name} array<double>"
    rows = rows.mapInArrow(multiply, schema)
    some = rows.groupBy("dim", F.floor(F.col("part") / 256).alias("_g")).applyInArrow(add, schema)
    out = np.zeros((width, width))
    # As many rows as dimensions.
    for r in some.groupBy("dim").applyInArrow(add, schema).collect():
        out[r["dim"]] = r[schema_name]
    return (out + out.T) / 2


def below(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric ``a`` below ``shift``: negative pivots of P(a - shift)P' = LDL' (Bunch and
    Kaufman 1977; blocks of D are 1 x 1 or 2 x 2, the latter with one negative eigenvalue each)."""
    m = a - shift * np.eye(len(a))
    tiny, alpha, negative, k, n = np.finfo(float).tiny, (1 + math.sqrt(17)) / 8, 0, 0, len(a)
    while k < n:
        column = np.abs(m[k + 1 :, k])
        r = k + 1 + int(column.argmax()) if k + 1 < n else k
        far, own = (column[r - k - 1] if r > k else 0.0), abs(m[k, k])
        pivot, two = k, False
        if far > 0 and own < alpha * far:
            row = np.abs(m[r, k:])
            row[r - k] = 0
            furthest = row.max()
            if own * furthest < alpha * far * far:
                if abs(m[r, r]) >= alpha * furthest:
                    pivot = r
                else:
                    two = True
        target = k + 1 if two else k
        swap = r if two else pivot
        if swap != target:
            m[[target, swap], k:] = m[[swap, target], k:]
            m[k:, [target, swap]] = m[k:, [swap, target]]
        if two:
            d = m[k : k + 2, k : k + 2]
            negative += 1
            c = m[k + 2 :, k : k + 2]
            if len(c):
                m[k + 2 :, k + 2 :] -= c @ np.linalg.solve(d, c.T)
            k += 2
        else:
            d = m[k, k] if m[k, k] != 0 else tiny
            negative += d < 0
            c = m[k + 1 :, k]
            if len(c) and c.any():
                m[k + 1 :, k + 1 :] -= np.outer(c, c / d)
            k += 1
    return negative


def _rayleigh(a: np.ndarray, low: float, high: float, against: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
    """Eigenpair in [low, high], orthogonal to the rows of ``against``. Inverse iteration at the interval's middle goes on
    until the residual is smaller than the way to the interval's ends; from there the nearest eigenvalue is the wanted
    one, and Rayleigh quotients as shifts converge cubically."""
    v = shift_vector(np.random.default_rng(seed).normal(size=len(a)))
    shift, best, worse = (low + high) / 2, (np.inf, v), 0
    for _ in range(100):
        w = _solve(a, shift, v)
        for _ in range(2):
            w = shift_vector(w - against.T @ (against @ w))
        v, rho = w, float(w @ a @ w)
        off = a @ v - rho * v
        error = float(np.linalg.norm(off - against.T @ (against @ off)))
        near = low <= rho <= high and (error < min(rho - low, high - rho) or len(against) > 0)
        if near and error < best[0]:
            best, worse = (error, v), 0
        elif best[0] < np.inf:
            worse += 1
            if worse > 2:
                break
        shift = rho if near else (low + high) / 2
    v = best[1]
    return float(v @ a @ v), v


def shift_vector(w: np.ndarray) -> np.ndarray:
    """``w`` at length 1, its largest entry positive."""
    w = w / np.linalg.norm(w)
    return -w if w[np.abs(w).argmax()] < 0 else w


def _solve(a: np.ndarray, shift: float, v: np.ndarray) -> np.ndarray:
    eye, scale = np.eye(len(a)), max(np.abs(a).max(), np.finfo(float).tiny)
    for nudge in (0.0, 1e-16, 1e-15, 1e-14):
        try:
            w = np.linalg.solve(a - (shift + nudge * scale) * eye, v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(w).all():
            return w
    return v


def eigenpair(a: np.ndarray, k: int) -> tuple[float, np.ndarray, bool]:
    """The k-th largest eigenvalue (from 1) of the symmetric ``a``, its unit eigenvector, and whether counts certify its
    number."""
    n = len(a)
    span = float(np.abs(a).sum(axis=1).max())
    low, high = -span * (1 + 1e-12) - 1e-300, span * (1 + 1e-12) + 1e-300
    counts = {low: n, high: 0}  # eigenvalues at or above

    def above(x: float) -> int:
        if x not in counts:
            counts[x] = n - below(a, x)
        return counts[x]

    # Close in until the interval, and as much again on both sides of it, holds one eigenvalue, or it is as narrow as a group.
    while high - low > TOGETHER * span:
        if counts[low] - counts[high] == 1 and above(2 * low - high) - above(2 * high - low) == 1:
            break
        middle = (low + high) / 2
        if above(middle) >= k:
            low = middle
        else:
            high = middle
    else:  # the whole group: on until there is a gap
        step = TOGETHER * span
        while above(low - step) > above(low):
            low -= step
        while above(high + step) < above(high):
            high += step
        low, high = low - step / 2, high + step / 2
    first, last = above(high) + 1, above(low)
    before, value, vector = np.zeros((0, n)), 0.0, np.zeros(n)
    group = []
    for i in range(first, last + 1):
        value, vector = _rayleigh(a, low, high, before, i)
        before = np.vstack([before, vector])
        group.append((value, i, vector))
    group.sort(key=lambda g: (-g[0], g[1]))
    value, _, vector = group[k - first]
    slack = max(8 * n * np.finfo(float).eps * span, 1e-300) if last == first else high - low
    sure = above(value + slack) < k <= above(value - slack)
    return value, vector, sure


def components(spark: SparkSession, covariance: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and unit eigenvectors (rows), largest first; zero ones are left out. One task per component; the
    covariance they share is as large as the dimensions squared, whatever the number of vectors."""
    width = len(covariance)
    wanted = min(wanted, width)
    trace = float(np.trace(covariance))
    if not wanted or not trace > 0:
        return np.empty(0), np.empty((0, width))
    shared = spark.sparkContext.broadcast(covariance / trace)

    def slice_spectrum(batches):
        for batch in batches:
            for k in batch["id"].to_pylist():
                value, vector, sure = eigenpair(shared.value, k)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([value]), pa.array([vector], pa.list_(pa.float64())), pa.array([sure])],
                                                 ["k", "value", "vector", "sure"])

    tasks = spark.range(1, wanted + 1, numPartitions=wanted).mapInArrow(slice_spectrum, "k long, value double, vector array<double>, sure boolean")
    found = sorted(tasks.collect(), key=lambda r: r["k"])
    shared.destroy()
    if not all(r["sure"] for r in found):
        raise ArithmeticError(f"inertia counts do not certify components {[r['k'] for r in found if not r['sure']]}")
    kept = [r for r in found if r["value"] > ZERO]
    return np.array([r["value"] * trace for r in kept]), np.array([r["vector"] for r in kept]).reshape(len(kept), width)


def whitened(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """Each usable row of ``vectors`` (vec_id, embedding) along each leading component: vec_id, component, n, deviation,
    whitened, explained, identity_error.

    Rows whose vector is null, or holds null or non-finite entries, take no part. Vectors shorter than the longest are
    read as if zeros followed; entries whose fixed-point form passes 2**53 count as that. Repeated rows count and come
    out as often as they stand there; a null vec_id stays null. Components without variance (one row, equal rows, fewer
    rows than dimensions) are left out, so there may be fewer than ``wanted``, or no rows at all. A deviation beyond 64
    bits is null. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    n, sums = _sums(rows)
    width = len(sums)
    total = np.array([s - n * SHIFT for s in sums], object)
    mean = np.array([s / n for s in total], float) if n else np.zeros(0)

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        x = fixed_point(batch["embedding"], width) - SHIFT
        if x.size and max(abs(int(x.min())), abs(int(x.max()))) * 2 * n < 1 << 62:
            return (x * n - total.astype(np.int64)) / n
        return x - mean

    covariance = _products(rows, width, centred, "products") / max(n, 1)
    values, axes = components(spark, covariance, wanted)
    trace = float(np.trace(covariance))
    turn = axes.T / np.sqrt(values)

    def along(batch: pa.RecordBatch) -> np.ndarray:
        return centred(batch) @ turn

    k = len(values)
    error = 0.0
    if k:
        spread = _products(rows, k, along, "products") / n
        error = float(np.abs(spread - np.eye(k)).max())

    def deviations(batch: pa.RecordBatch) -> list[int | None]:
        x = fixed_point(batch["embedding"], width) - SHIFT
        big = 2 * n * max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
        if big * big * max(width, 1) < 1 << 62:
            return (((x * n - total.astype(np.int64)) ** 2).sum(axis=1)).tolist()
        return [d if d < 1 << 63 else None for d in ((x.astype(object) * n - total) ** 2).sum(axis=1)]

    def write(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                yield pa.RecordBatch.from_arrays(
                    [part["vec_id"], pa.array(deviations(part), pa.int64()), pa.array(list(along(part)), pa.list_(pa.float64()))],
                    ["vec_id", "deviation", "values"])

    if not k:
        rows = rows.limit(0)
    out = rows.mapInArrow(write, "vec_id long, deviation long, values array<double>")
    shares = F.array(*[F.lit(float(v / trace)) for v in values]) if k else F.array(F.lit(0.0))
    return out.select("vec_id", "deviation", F.posexplode("values").alias("p", "whitened")).select(
        "vec_id", (F.col("p") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("p")].alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(table(spark, folder, "embeddings").select("vec_id", "embedding"))
