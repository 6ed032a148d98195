import hashlib
from collections import defaultdict

import duckdb
import pytest

from helixmart.llm.sharding import extendible_shards, op6_sharding, sharding_sql

SCHEMA = "doc_id long, text string, depth int"


def brute(rows, limit):
    """Split oversized buckets one bit at a time; rows of one key stay together down to bit 64."""
    out = {}

    def split(items, prefix):
        size = sum(n for _, _, n in items)
        if size <= limit or len(items) == 1 or len(prefix) == 64:
            for i, _, _ in items:
                out[i] = (prefix, size, len(items))
            return
        for bit in "01":
            split([x for x in items if x[1][len(prefix)] == bit], prefix + bit)

    items = []
    for i, (key, text) in enumerate(rows):
        h = hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16]
        items.append((i, f"{int(h, 16):064b}", len((text or "").encode())))
    split(items, "")
    return out


@pytest.mark.parametrize("limit", [10_000, 200, 40])
def test_matches_splitting_by_hand(spark, limit):
    rows = [(i, "ä" * (i % 17), 5) for i in range(400)] + [(None, None, 1), (7000, "x" * 500, 2)]
    got = extendible_shards(spark.createDataFrame(rows, SCHEMA), limit).collect()
    want = brute([r[:2] for r in rows], limit)
    by_key = {key: want[i] for i, (key, _, _) in enumerate(rows)}
    assert len(got) == len(rows)
    for r in got:
        assert (r.shard, r.shard_bytes, r.shard_rows) == by_key[r.doc_id]
        assert r.depth == len(r.shard) and r.oversized == (r.shard_bytes > limit)


def test_hot_key_is_split_below_the_limit(spark):
    rows = [(1, "y" * 10, 0)] * 300 + [(i, "z" * 10, 0) for i in range(2, 100)]
    got = extendible_shards(spark.createDataFrame(rows, SCHEMA), 200).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.n_bytes
    assert len(got) == 398 and max(sizes.values()) <= 200
    assert all(r.shard_bytes == sizes[r.shard] and not r.oversized for r in got)
    assert any(r.depth > 64 for r in got if r.doc_id == 1)


def test_empty_table_and_empty_texts(spark):
    assert extendible_shards(spark.createDataFrame([], SCHEMA)).count() == 0
    got = extendible_shards(spark.createDataFrame([(1, "", 0), (None, None, 0)], SCHEMA)).collect()
    assert {(r.shard, r.shard_bytes, r.shard_rows) for r in got} == {("", 0, 2)}


@pytest.mark.parametrize("limit", [16 << 20, 30_000])
def test_matches_sql(spark, tiny, limit):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    names = ["doc_id", "shard", "depth", "n_bytes", "shard_bytes", "shard_rows", "oversized"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({sharding_sql(limit)})").fetchall()
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = [tuple(r[n] for n in names) for r in extendible_shards(docs, limit).collect()]
    assert sorted(got) == sorted(want)


def test_plan_has_no_python(spark, tiny):
    plan = op6_sharding(spark, tiny)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
