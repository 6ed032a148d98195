import numpy as np
import pytest

from helixmart.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, component string"


def brute(vectors, wanted=W.COMPONENTS):
    """(n, deviations, eigenvalues, explained, whitened without signs) from numpy's own solver and whole numbers."""
    width = max(map(len, vectors))
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    z = n * x - s
    y = (z / n).astype(float)
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    keep = [i for i in range(width)[::-1] if e[i] > 1e-12 * np.trace(cov)][:wanted]
    return n, (z**2).sum(axis=1).tolist(), e[keep], e[keep] / np.trace(cov), y @ v[:, keep] / np.sqrt(e[keep])


def check(rows, vectors):
    n, deviations, _, explained, expected = brute(vectors)
    k = len(explained)
    assert len(rows) == n * k
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == n * k
    for c in range(k):
        column = np.array([got[i, c + 1].whitened for i in range(n)])
        assert min(np.abs(column - expected[:, c]).max(), np.abs(column + expected[:, c]).max()) < 1e-6
        assert got[0, c + 1].explained == pytest.approx(explained[c], rel=1e-9)
    for i in range(n):
        assert got[i, 1].deviation == deviations[i] and got[i, 1].n == n
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-6


@pytest.mark.parametrize(("n", "width"), [(300, 48), (40, 6), (9, 12)])
def test_against_numpy(spark, n, width):
    rng = np.random.default_rng(n)
    vectors = (rng.normal(size=(n, width)) * np.geomspace(0.5, 5, width)).astype(np.float32).tolist()
    bad = [(900, None), (901, [1.0, None] * (width // 2)), (902, [float("nan")] * width), (903, [float("inf")] + [0.0] * (width - 1))]
    df = spark.createDataFrame([*enumerate(vectors), *bad], "vec_id long, embedding array<float>").selectExpr("*", "'x' AS component").repartition(5)
    check(W.whitened(df).collect(), vectors)


def test_short_repeated_and_null_ids(spark):
    vectors = [[1.0, 2.0, 0.5], [1.0], [], [-3.0, 0.25, 8.0], [0.0, -7.5, 1.0]]
    df = spark.createDataFrame([(i, v, "") for i, v in enumerate(vectors)], SCHEMA)
    check(W.whitened(df).collect(), vectors)
    twice = W.whitened(df.union(spark.createDataFrame([(None, [1.0, 2.0, 0.5], "")], SCHEMA))).collect()
    assert {(r.vec_id, r.n) for r in twice} == {(i, 6) for i in (None, 0, 1, 2, 3, 4)}


def test_no_variance_and_empty(spark):
    for rows in ([], [(1, [1.0, 2.0], "")], [(i, [0.5, 0.25], "") for i in range(4)], [(1, [], "")], [(1, None, "")]):
        assert W.whitened(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_large_entries(spark):
    df = spark.createDataFrame([(0, [1e30, 0.0], ""), (1, [-1e30, 1.0], ""), (2, [3.0, 2.0], "")], SCHEMA)
    rows = W.whitened(df).collect()
    assert {r.deviation for r in rows if r.vec_id < 2} == {None}
    assert all(np.isfinite(r.whitened) for r in rows)


@pytest.mark.parametrize("values", [[5.0] * 6 + [3.0] + [1.0] * 13, [1 + 1e-9 * i for i in range(20)], list(range(1, 21)), [4.0] + [1e-6] * 19])
def test_spectrum_slicing(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(20, 20)))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    pairs = [W.eigenpair(a, k) for k in range(1, 21)]
    found, vectors = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    top = max(values)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-12 * top and all(p[2] for p in pairs)
    assert np.abs(vectors @ vectors.T - np.eye(20)).max() < 1e-5
    assert np.abs(a @ vectors.T - vectors.T * found).max() < 1e-8 * top


def test_inertia_counts():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 31):
        for _ in range(20):
            a = rng.integers(-2, 3, (n, n)).astype(float)
            a = a + a.T
            shift = float(rng.normal() * 3)
            assert W.below(a, shift) == (np.linalg.eigvalsh(a) < shift).sum()


def test_whole_table(spark, tiny):
    df = W.op13_whitening(spark, tiny)
    rows = df.collect()
    n = rows[0].n
    assert len(rows) == 32 * n and rows[0].identity_error < 1e-9
    m = np.zeros((n, 32))
    at = {v: i for i, v in enumerate(sorted({r.vec_id for r in rows}))}
    for r in rows:
        m[at[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(m.T @ m / n - np.eye(32)).max() < 1e-9
