import duckdb
import numpy as np
import pytest

from helixmart.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, dim string"


def brute(rows, queries, k):
    out = set()
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    first = {i: v for i, v in reversed(sorted(good, key=lambda g: (g[0], len(g[1]), g[1].tolist())))}
    for qi, q in first.items():
        if qi in queries:
            near = [(-np.cumsum(q * v)[-1], i) for i, v in good if i != qi and len(v) == len(q)]
            out |= {(qi, r, i, -s) for r, (s, i) in enumerate(sorted(near)[:k], 1)}
    return out


@pytest.mark.parametrize(("n", "tile"), [(300, 8192), (900, 100), (5, 8192)])
def test_against_all_products(spark, monkeypatch, n, tile):
    monkeypatch.setattr(N, "TILE_VECTORS", tile)
    monkeypatch.setattr(N, "TILE_QUERIES", max(4, tile // 20))
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 12)).astype(np.float32)
    v[n // 3 : n // 2] = v[0]  # a third of all are one vector: ties
    v[n // 2] *= 1e-6
    v[n // 2 + 1] *= 1e6
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(None, [1.0] * 12), (100_000, None), (100_020, [0.0] * 12), (100_040, [1.0, None] * 6), (100_060, [float("nan")] * 12),
             (100_080, [float("inf")] * 12), (100_100, []), (100_120, [1.0, 2.0]), (100_140, [3.0, 4.0]), rows[0], *[rows[1]] * 9]
    df = spark.createDataFrame([(i, x, "s") for i, x in rows], SCHEMA)
    queries = {i for i, _ in rows if i is not None and i % 20 == 0}
    got = N.nearest(df, df.where("vec_id % 20 = 0"), 7).collect()
    assert len(got) == len(set(got))
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute(rows, queries, 7)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(50, 33)), rng.normal(size=(400, 33)) * 10.0 ** rng.integers(-8, 8, (400, 1))
    (q8, qs, qr), (c8, cs, cr) = N.quantised(q), N.quantised(c)
    near = (q8.astype(float) @ c8.astype(float).T) * qs[:, None] * cs
    ql, cl = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    assert (np.abs(near - q @ c.T) <= qr[:, None] * cl + (ql + qr)[:, None] * cr + 1e-12 * ql[:, None] * cl).all()


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert N.nearest(none, none).count() == 0


def test_matches_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tiny}/embeddings.parquet'")
    want = con.execute(N.nearest_sql()).fetchall()
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in N.op7_nearest(spark, tiny).collect()]
    assert sorted(got) == sorted(want)
