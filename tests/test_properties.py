"""Properties on small hand-made inputs, compared with brute force in plain Python."""

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from helixmart.operators import documents as D, events as E, ml, probes, ranking, similarity as S, stats


def reference_chunks(pages, size=1000, overlap=200):
    text = "".join(p + "\n" for p in pages)
    owner = [i + 1 for i, p in enumerate(pages) for _ in range(len(p) + 1)]
    return [(i, text[s:s + size], s, min(s + size, len(text)), sorted(set(owner[s:s + size])))
            for i, s in enumerate(range(0, len(text), size - overlap))]


@pytest.mark.parametrize("pages", [
    [""], ["x"], ["a" * 798], ["a" * 799], ["a" * 800], ["b" * 999], ["b" * 1000], ["c" * 1800],
    ["d" * 700, "", "e" * 1500], ["é😀" * 900, "z" * 10], ["p" * 50] * 60])
def test_chunks_equal_brute_force(spark, pages):
    df = spark.createDataFrame([("P1", pages)], "paper_id string, pages array<string>")
    rows = sorted(D.chunk(df).collect(), key=lambda r: r["chunk_index"])
    want = reference_chunks(pages)
    assert [(r["chunk_index"], r["chunk_text"], r["start_char"], r["end_char"], list(r["pages_spanned"])) for r in rows] == want
    full = "".join(p + "\n" for p in pages)
    assert {r["content_hash"] for r in rows} == {hashlib.sha256(full.encode()).hexdigest()}
    assert "".join(r["chunk_text"][: 800] for r in rows[:-1]) + rows[-1]["chunk_text"] == full
    again = sorted(D.chunk_page_rows(D.page_rows(df), hashed=True).collect(), key=lambda r: r["chunk_index"])
    assert {r["content_hash"] for r in again} == {hashlib.sha256(full.encode()).hexdigest()}
    assert [(r["chunk_index"], r["chunk_text"], r["start_char"], r["end_char"], list(r["pages_spanned"])) for r in again] == want
    assert all(r["chunk_hash"] == hashlib.sha256(r["chunk_text"].encode()).hexdigest() for r in rows)


def test_split_pages_keeps_whole_text(spark):
    text = "".join(random.Random(1).choice("abcé \n") for _ in range(9001))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    rows = {r["paper_id"]: r["pages"] for r in D.split_pages(df, F.col("id")).collect()}
    assert "".join(rows[1]) == text and rows[2] == [""] and 3 not in rows


def test_quantiles_with_a_hot_group(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.choice([-1, 1]) * rnd.expovariate(1.0)) for _ in range(4000)]
    rows += [("hot", 0.5)] * 500 + [("small", 2.0), ("small", None), ("two", -1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in ranking.group_quantiles(df, ["k"], "v", {"q25": 0.25, "q50": 0.5, "q95": 0.95}).collect()}
    hot = sorted(v for k, v in rows if k == "hot")

    def at(values, p):
        x = (len(values) - 1) * p
        low = math.floor(x)
        high = min(low + 1, len(values) - 1)
        return values[low] + (values[high] - values[low]) * (x - low)

    for name, p in (("q25", 0.25), ("q50", 0.5), ("q95", 0.95)):
        assert got["hot"][name] == pytest.approx(at(hot, p), abs=1e-12)
    assert got["small"]["q50"] == 2.0 and got["two"]["q25"] == 0.25
    assert got["hot"]["q50"] == pytest.approx(statistics.median(hot))


def test_hashed_rank_is_a_permutation(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 2500, "a").otherwise("b").alias("g"))
    rows = ranking.hashed_rank(df, "g", F.col("id")).collect()
    for g, n in (("a", 2500), ("b", 500)):
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: hashlib.md5(r["id"].encode()).hexdigest())
        assert [r["hash_rank"] for r in mine] == list(range(1, n + 1))


def vectors(spark, n, seed, model=None, start=0):
    rnd = random.Random(seed)
    rows = [(start + i, [float(rnd.randint(-3, 3)) for _ in range(6)]) for i in range(n)]
    rows[0] = (start, [0.0] * 6)
    return rows, spark.createDataFrame(rows, "id bigint, embedding array<float>")


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return 0.0 if na == 0 or nb == 0 else sum(x * y for x, y in zip(a, b)) / na / nb


@pytest.mark.parametrize("limit", [4096, 8])
def test_vector_search_equals_brute_force_also_in_tiles(spark, limit):
    corpus, cdf = vectors(spark, 300, 1)
    queries, qdf = vectors(spark, 40, 2, start=1000)
    qdf = qdf.withColumnRenamed("id", "query_id")
    got = {}
    for r in probes.vector_top_k(cdf.repartition(5), qdf, "id", "query_id", k=3, min_score=0.3, size=limit).collect():
        got.setdefault(r["query_id"], {})[r["place"]] = (r["id"], r["score"])
    for q, v in queries:
        want = sorted(((-round(cosine(v, c), 9), i) for i, c in corpus if round(cosine(v, c), 9) > 0.3))[:3]
        mine = [got.get(q, {}).get(p + 1) for p in range(len(want))]
        assert [m[0] for m in mine] == [i for _, i in want]
        assert len(got.get(q, {})) == len(want)
    best = {r["id"]: (r["query_id"], r["score"]) for r in probes.vector_best(
        cdf, qdf, "id", "query_id", min_score=None, size=limit).collect()}
    for i, c in corpus:
        want = min((-round(cosine(c, v), 9), q) for q, v in queries)
        assert best[i][0] == want[1]


def test_vector_search_refuses_mixed_models(spark):
    _, cdf = vectors(spark, 5, 1)
    _, qdf = vectors(spark, 5, 2)
    mixed = qdf.withColumn("model", F.when(F.col("id") < 2, "a").otherwise("b")).withColumnRenamed("id", "query_id")
    with pytest.raises(ValueError):
        probes.vector_top_k(cdf.withColumn("model", F.lit("a")), mixed, "id", "query_id")


def patients(spark, n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # a third of all rows share one cell
        cell = (60, 8.0, 200) if i % 3 == 0 else (rnd.randint(30, 90), rnd.randint(0, 240) / 8, rnd.randint(0, 600))
        rows.append((f"S{i:04d}", *cell, float(i % 50), "SHORT" if i % 2 else "LONG", 1))
    rows.append(("S-null", None, 3.0, 10, 1.0, "LONG", 0))
    return rows, spark.createDataFrame(
        rows, "sample_id string, age bigint, tmb double, mutation_count bigint, target_survival_months double, "
              "target_category string, target_event int")


def test_similar_patients_equal_brute_force(spark):
    rows, df = patients(spark, 400, 5)
    near = lambda a, b: None not in (a[1], b[1]) and abs(a[1] - b[1]) <= 10 and abs(a[2] - b[2]) <= 5
    counts = {r["sample_id"]: r["similar_patients_found"] for r in S.count_similar(df, df).collect()}
    assert counts == {a[0]: sum(near(a, b) for b in rows) for a in rows}
    by_burden, by_both = {}, {}
    for r in S.nearest_by_burden(df, df).collect():
        by_burden.setdefault(r["sample_id"], {})[r["place"]] = r["neighbour_id"]
    for r in S.nearest_by_age_and_burden(df, df).collect():
        by_both.setdefault(r["sample_id"], {})[r["place"]] = r["neighbour_id"]
    for a in rows:
        close = [b for b in rows if near(a, b)]
        want = [b[0] for b in sorted(close, key=lambda b: (abs(b[2] - a[2]), b[0]))[:5]]
        assert [by_burden.get(a[0], {})[i + 1] for i in range(len(want))] == want
        close = [b for b in close if abs(b[3] - a[3]) <= 100]
        want = [b[0] for b in sorted(close, key=lambda b: (abs(b[1] - a[1]) + abs(b[2] - a[2]), b[0]))[:8]]
        assert [by_both.get(a[0], {})[i + 1] for i in range(len(want))] == want


@pytest.mark.parametrize("limit", [4096, 2])
def test_profile_counts_equal_brute_force(spark, limit):
    rnd = random.Random(9)
    rows = [(f"S{i}", *[rnd.uniform(0, 15) for _ in range(4)]) for i in range(120)]
    names = S.MARKER_COLUMNS
    df = spark.createDataFrame(rows, "sample_id string, " + ", ".join(f"{n} double" for n in names))
    queries = df.limit(7).withColumnRenamed("sample_id", "q")
    got = {r["q"]: r["n"] for r in probes.range_counts(df, queries, names, "q", 2.0, size=limit).collect()}
    for q in queries.collect():
        assert got[q["q"]] == sum(any(abs(r[i + 1] - q[names[i]]) <= 2 for i in range(4)) for r in rows)


def test_gap_sessions_equal_brute_force(spark):
    rnd = random.Random(4)
    rows = [("u1" if i % 3 else "u2", 1_700_000_000 + rnd.randint(0, 200_000)) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id string, s bigint").withColumn("app_timestamp", F.timestamp_seconds("s"))
    got = sorted((r["user_id"], r["n_events"]) for r in E.gap_sessions(df, "user_id").collect())
    want = []
    for user in ("u1", "u2"):
        times = sorted(t for u, t in rows if u == user)
        size = 1
        for a, b in zip(times, times[1:]):
            if b - a > 1800:
                want.append((user, size))
                size = 0
            size += 1
        want.append((user, size))
    assert got == sorted(want)


def test_stratified_shares_are_exact(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    split = stats.stratified_split(df, "y", "sample_id")
    counts = {(r["y"], r["split"]): r["count"] for r in split.groupBy("y", "split").count().collect()}
    assert counts == {(1, "test"): 50, (1, "train"): 200, (0, "test"): 150, (0, "train"): 600}
    folds = stats.stratified_folds(df, "y", "sample_id").groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds if r["y"] == 1} == {50}


def test_ledger_runs_once(spark, tmp_path):
    from helixmart.sources.sinks import append_ledger

    chunks = spark.createDataFrame([("P1", 0), ("P1", 1), ("P2", 0)], "paper_id string, chunk_index int")
    path = str(tmp_path / "ledger")
    empty = spark.createDataFrame([], "paper_id string")
    append_ledger(D.text_ledger_rows(chunks, empty), path)
    assert {(r["paper_id"], r["text_chunks_count"]) for r in spark.read.parquet(path).collect()} == {("P1", 2), ("P2", 1)}
    assert D.text_ledger_rows(chunks, spark.read.parquet(path)).count() == 0


def test_components_agree_between_orientations(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(f"g{g}", f"s{s}", rnd.gauss(0, 1) + (3.0 if s < 4 and g < 5 else 0.0)) for g in range(12) for s in range(9)]
    df = spark.createDataFrame(rows, "gene_symbol string, sample_id string, value double")
    by_gene = {r["sample_id"]: r for r in ml.sample_components(df).collect()}
    by_sample = {r["sample_id"]: r for r in ml.sample_components(df, columns=10).collect()}
    for s, r in by_gene.items():
        assert abs(r["pc1"]) == pytest.approx(abs(by_sample[s]["pc1"]), abs=1e-6)
        assert r["share1"] == pytest.approx(by_sample[s]["share1"], abs=1e-9)


def test_quantiles_of_values_that_nearly_agree(spark):
    rnd = random.Random(8)
    values = [1000 + rnd.random() * 0.5 for _ in range(20_000)] + [-1e-300, 5e-324, 0.0, 1e308, -1e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = {"q01": 0.01, "q50": 0.5, "q99": 0.99, "low": 0.0, "high": 1.0}
    got = ranking.group_quantiles(df, [], "v", probs).first()
    ordered = sorted(values)
    for name, p in probs.items():
        at = (len(ordered) - 1) * p
        low = math.floor(at)
        high = min(low + 1, len(ordered) - 1)
        assert got[name] == pytest.approx(ordered[low] + (ordered[high] - ordered[low]) * (at - low), rel=1e-15)
    # One task would sort all of them if only buckets parted them; the parts hold a handful each.
    b = df.where("v BETWEEN 999 AND 1001").withColumn("b", ranking._octave(F.col("v")))
    assert b.groupBy("b").count().agg(F.max("count")).first()[0] == 20_000
    s = b.crossJoin(b.agg(F.min("v").alias("low"), F.max("v").alias("high"))).withColumn(
        "s", ranking._part(F.col("v"), F.col("low"), F.col("high")))
    assert s.groupBy("b", "s").count().agg(F.max("count")).first()[0] < 10


def test_vector_blocks_leave_out_only_what_cannot_score():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    rows = rng.normal(size=(500, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    for spread in (0.01, 0.3, 3.0):
        vectors = rng.normal(size=8) + rng.normal(size=(20, 8)) * spread
        block = probes.VectorBlock(pd.DataFrame({"q": range(20), "v": list(vectors)}), "q", "v")
        assert (block.ceiling(rows) >= (rows @ block.unit.T).max(axis=1)).all()
        if spread == 0.01:
            assert (block.ceiling(rows) < 0.9).mean() > 0.5
    with_zero = probes.VectorBlock(pd.DataFrame({"q": [1, 2], "v": [[0.0] * 8, [1.0] * 8]}), "q", "v")
    assert (with_zero.ceiling(rows) >= 1).all()


def test_one_plan_for_any_number_of_probes(spark):
    from compare import plan

    _, corpus = vectors(spark, 50, 1)
    shapes = set()
    for n in (3, 3000):
        _, asked = vectors(spark, n, 2)
        text = plan(probes.vector_top_k(corpus, asked.withColumnRenamed("id", "query_id"), "id", "query_id"))
        assert "CoGroup" not in text and "Generate" not in text
        shapes.add(tuple(line.strip().split(" ")[0] for line in text.splitlines()))
    assert len(shapes) == 1
