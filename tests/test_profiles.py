"""Tree search and range counts against all pairs, with trees of many leaves."""

import math
import random

import numpy as np
import pytest

from helixmart.operators import profiles as P

COLUMNS = ["a", "b", "c", "d"]
SCHEMA = "id long, a double, b double, c double, d double, kind string"


def made(seed, n):
    r = random.Random(seed)
    rows = [(i, *(round(r.gauss(5, 4), r.choice([0, 1, 6])) for _ in COLUMNS), r.choice("xy")) for i in range(n)]
    rows += [(n + i, 1.0, -0.0, 2.5, 3.0, "x") for i in range(n // 3)]  # one point holds many rows
    return rows + [(9000, None, 1.0, 1.0, 1.0, "x"), (9001, math.nan, 1.0, 1.0, 1.0, "y"), (9002, math.inf, 0.0, 0.0, 0.0, "y"), (9003, 1.0, 0.0, 2.5, 3.0, "y")]


def known(rows):
    return [r for r in rows if all(v is not None and math.isfinite(v) for v in r[1:5])]


@pytest.mark.parametrize(("n", "leaf"), [(400, 16), (400, 4000), (60, 1), (3, 2)])
@pytest.mark.parametrize("any_of", [True, False])
def test_counts(spark, n, leaf, any_of):
    rows = made(n, n)
    reach = dict(zip(COLUMNS, (2.0, 2.0, 1.0, 4.0), strict=True))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r[c] for c in COLUMNS): r["n"] for r in P.counts_of_all(df, df, reach, any_of, leaf).collect()}
    good = known(rows)
    test = any if any_of else all
    points = {tuple(v + 0.0 for v in r[1:5]) for r in good}
    assert got == {q: sum(test(q[j] - w <= r[1 + j] <= q[j] + w for j, w in enumerate(reach.values())) for r in good) for q in points}


def nearest(rows, queries, k, distance):
    out = set()
    for q in {tuple(v + 0.0 for v in r[1:5]) for r in queries}:
        near = sorted((d, r[0]) for r in rows if (d := distance(q, r[1:5])) < math.inf)
        out |= {(*q, i, place, d) for place, (d, i) in enumerate(near[:k], 1)}
    return out


def straight(q, p):
    return float(np.round(np.sqrt(sum((x - y) ** 2 for x, y in zip(p, q, strict=True))), 9))


def ranged(q, p):
    gaps = [abs(x - y) for x, y in zip(p, q, strict=True)]
    return math.inf if any(g > w for g, w in zip(gaps, (3.0, 2.0, 8.0, 8.0), strict=True)) else gaps[0] + gaps[1]


@pytest.mark.parametrize(("n", "leaf", "k"), [(400, 16, 5), (400, 4000, 5), (60, 1, 8), (3, 2, 5)])
@pytest.mark.parametrize(("metric", "distance"), [(None, straight), (P.WithinRanges([3, 2, 8, 8], [True, True, False, False]), ranged)])
def test_nearest(spark, n, leaf, k, metric, distance):
    rows = made(n + 1, n)
    df = spark.createDataFrame(rows, SCHEMA)
    got = P.nearest_of_all(df, df.where("kind = 'x'"), COLUMNS, "id", k, ["kind"], metric, leaf).collect()
    assert {r["kind"] for r in got} <= {"x"}
    found = {(*(r[c] for c in COLUMNS), r["id"], r["place"], r["distance"]) for r in got}
    assert len(found) == len(got)
    assert found == nearest([r for r in known(rows) if r[5] == "x"], known(rows), k, distance)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(made(1, 5), SCHEMA)
    assert P.nearest_of_all(none, some, COLUMNS, "id").count() == 0 and P.nearest_of_all(some, none, COLUMNS, "id").count() == 0
    assert P.counts_of_all(none, some, {"a": 1.0}).count() == 0
    assert {r["n"] for r in P.counts_of_all(some, none, {"a": 1.0}).collect()} == {0}


def test_tree_cuts_dense_regions(spark):
    points = np.concatenate([np.random.default_rng(1).normal(size=(4000, 2)), np.random.default_rng(2).normal(size=(40, 2)) + 50])
    tree = P.KdTree.build(points, 5)
    sizes = np.bincount(tree.leaf(points), minlength=32)
    assert sizes.max() <= 2 * len(points) / 32


def test_undecided_leaves_are_never_held_for_all_points():
    import tracemalloc

    r = np.random.default_rng(3)
    points, reach = r.uniform(0, 16, (20_000, 4)), np.full(4, 2.0)
    tree = P.KdTree.build(points, 9)
    leaf = tree.leaf(points)
    rows = [{"leaf": i, "low": points[leaf == i].min(axis=0), "high": points[leaf == i].max(axis=0), "n": int((leaf == i).sum())} for i in np.unique(leaf)]
    boxes = P.LeafBoxes(rows, 9, 4)
    found, asked, seen = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64), []
    tracemalloc.start()
    for there, at in boxes.border(points, reach, True, found):
        seen.append(there)
        asked[at] += boxes.rows[there + (1 << 9)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == sorted(set(seen)) and asked.sum() > 100 * len(points) * 20 and peak < 32e6
    near = np.array([(np.abs(points - q) <= 2).any(axis=1).sum() for q in points[:50]])
    assert (found[:50] <= near).all() and (near <= found[:50] + asked[:50]).all()


def test_reached_leaves_come_in_pieces():
    import tracemalloc

    r = np.random.default_rng(5)
    corpus, points, radius, metric = r.uniform(0, 16, (20_000, 4)), r.uniform(0, 16, (10_000, 4)), r.uniform(2, 12, 10_000), P.Euclidean()
    tree = P.KdTree.build(corpus, 9)
    leaf = tree.leaf(corpus)
    rows = [{"leaf": i, "low": corpus[leaf == i].min(axis=0), "high": corpus[leaf == i].max(axis=0), "n": int((leaf == i).sum())} for i in np.unique(leaf)]
    boxes, n, some = P.LeafBoxes(rows, 9, 4), 0, set()
    tracemalloc.start()
    for at, there in boxes.reached(points, radius, metric):
        n += len(at)
        few = at < 20
        some |= set(zip(at[few].tolist(), there[few].tolist(), strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 1_000_000 and peak < 64e6
    low, high = boxes.low[1 << 9 :], boxes.high[1 << 9 :]
    wanted = {(i, j) for i in range(20) for j in np.flatnonzero(metric.nearest(np.repeat(points[i : i + 1], 512, axis=0), low, high) <= radius[i]).tolist()}
    assert some == wanted
