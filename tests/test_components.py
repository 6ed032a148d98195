"""Components of matrices wide on both sides, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmart.operators import components, ml


def long_form(spark, rows, columns, noise=1.0):
    """A planted matrix that Spark and numpy both know: three strong directions and hash noise."""
    df = spark.range(rows * columns).select((F.col("id") % rows).alias("r"), F.floor(F.col("id") / rows).alias("c"))
    noisy = (F.pmod(F.xxhash64("r", "c"), F.lit(10007)) / 10007.0 - 0.5) * noise
    value = (F.sin(F.col("r") * 0.7) * F.cos(F.col("c") * 0.3) * 3 + F.cos(F.col("r") * 1.3) * F.sin(F.col("c") * 0.11) * 2
             + F.sin(F.col("r") * 0.05) * F.cos(F.col("c") * 0.9) + noisy)
    return df.select(F.format_string("s%05d", "r").alias("sample_id"), F.format_string("g%05d", "c").alias("gene_symbol"), value.alias("value"))


def by_numpy(df, rows, columns, k):
    table = df.select(F.substring("sample_id", 2, 5).cast("int").alias("r"), F.substring("gene_symbol", 2, 5).cast("int").alias("c"), "value").toArrow()
    a = np.zeros((rows, columns))
    a[table["r"].to_numpy(), table["c"].to_numpy()] = table["value"].to_numpy()
    z = (a - a.mean(axis=0)) / a.std(axis=0)
    values, vectors = np.linalg.eigh(z @ z.T if rows <= columns else z.T @ z)
    order = np.argsort(values)[::-1][:k]
    u = vectors[:, order] * np.sqrt(values[order]) if rows <= columns else z @ vectors[:, order]
    return values[order] / (z**2).sum(), u


def check(spark, rows, columns, k=2):
    df = long_form(spark, rows, columns)
    got = ml.sample_components(df, k, columns=10).collect()
    shares, u = by_numpy(df, rows, columns, k)
    assert len(got) == rows
    for i in range(k):
        assert got[0][f"share{i + 1}"] == pytest.approx(shares[i], rel=1e-6)
        mine = np.array([r[f"pc{i + 1}"] for r in sorted(got, key=lambda r: r["sample_id"])])
        assert min(np.abs(mine - u[:, i]).max(), np.abs(mine + u[:, i]).max()) < 1e-3 * np.abs(u[:, i]).max()


@pytest.mark.parametrize(("rows", "columns"), [(60, 90), (90, 60), (15, 40)])
def test_small(spark, monkeypatch, rows, columns):
    monkeypatch.setattr(components, "SIDE", 16)
    monkeypatch.setattr(components, "STACK", 3)
    check(spark, rows, columns)


def test_both_sides_wide(spark):
    check(spark, 3000, 5000)


def test_same_as_gene_columns(spark):
    df = long_form(spark, 80, 30)
    narrow, wide = ml.sample_components(df).collect(), ml.sample_components(df, columns=10).collect()
    assert narrow[0]["share1"] == pytest.approx(wide[0]["share1"], rel=1e-6) and narrow[0]["share2"] == pytest.approx(wide[0]["share2"], rel=1e-6)
