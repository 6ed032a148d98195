import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from helixmart.llm import language_model as L
from helixmart.llm.elias_fano import EliasFano, Trie

SCHEMA = "doc_id long, text string, train boolean"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORDS.findall(low), "<end>"]


def brute(rows, order, strength):
    """(doc_id, train, n_tokens, n_known, train_tokens, base, score) by plain counting."""
    counts = Counter()
    for _, text, train in rows:
        if train:
            t = ["<start>", *tokens(text)]
            for i in range(1, len(t)):
                for n in range(1, order + 1):
                    if i - n + 1 >= (0 if n > 1 else 1):
                        counts[tuple(t[i - n + 1 : i + 1])] += 1
    total = sum(c for g, c in counts.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in counts)
    counts["<start>",] = counts["<end>",]
    out = []
    for doc_id, text, train in rows:
        t, base, score, known = ["<start>", *tokens(text)], 0.0, 0.0, 0
        for i in range(1, len(t)):
            p = (counts[t[i],] + 0.1) / (total + 0.1 * (distinct + 1))
            base += math.log10(p)
            known += counts[t[i],] > 0
            for n in range(2, order + 1):
                if i - n + 1 >= 0:
                    p = (counts[tuple(t[i - n + 1 : i + 1])] + strength * p) / (counts[tuple(t[i - n + 1 : i])] + strength)
            score += math.log10(p)
        out.append((doc_id, train, len(t) - 1, known, total, base, score))
    return out


def compare(got, rows, order, strength):
    def key(r):
        return (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 6), round(r[6], 1))

    got = sorted([(r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    want = sorted(brute(rows, order, strength), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert abs(g[6] - w[6]) <= 3e-4 * g[2]


def corpus(seed, n):
    r = random.Random(seed)
    words = ["The", "the", "a", "ÄB", "äb", "x\x1fy", "cat", "sat", "on", "mat.", "10", "of"]
    rows = [(i, r.choice([" ", "\n", "\t ", "  "]).join(r.choices(words, weights=range(1, 13), k=r.choice([0, 1, 2, 5, 40]))), r.random() < 0.8) for i in range(n)]
    rows += [(n, None, True), (n + 1, "", False), (n + 2, " \x0b\x0c ", True), (None, "the cat sat", True), (None, "the cat", False), rows[0], rows[0]]
    return rows + [(n + 3 + i, "the cat sat on", True) for i in range(n // 2)]


@pytest.mark.parametrize(("order", "chunk", "shards"), [(2, 1 << 21, 3), (3, 1 << 21, 1), (3, 7, 5), (2, 1, 2)])
def test_against_counting(spark, order, chunk, shards):
    rows = corpus(order, 60)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS chunk", "1 AS shard").repartition(4)
    compare(L.scores(df, order, 5.0, chunk, shards).collect(), rows, order, 5.0)


def test_one_long_text(spark):
    r = random.Random(9)
    rows = [(1, " ".join(f"w{min(r.randrange(200), r.randrange(200))}" for _ in range(30_000)), True), (2, "w1 w2 w3", False)]
    compare(L.scores(spark.createDataFrame(rows, SCHEMA), 3, 20.0, 4096, 4).collect(), rows, 3, 20.0)


def test_nothing_to_learn_from(spark):
    rows = [(1, "a b", False), (2, None, False)]
    compare(L.scores(spark.createDataFrame(rows, SCHEMA)).collect(), rows, L.ORDER, L.STRENGTH)
    assert L.scores(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    rows = [(i, t, zlib.crc32(str(i).encode()) % 10 != 0) for i, t in docs]
    got = L.op11_language_model(spark, tiny).withColumnRenamed("held_out", "h").selectExpr("*", "NOT h AS train").collect()
    compare(got, rows, L.ORDER, L.STRENGTH)
    held = [r for r in got if r.h]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("fields", [(64,), (22, 20), (16, 13, 13)])
def test_trie(fields):
    rng, bits = np.random.default_rng(4), sum(fields)
    keys = np.unique(rng.integers(0, 2**bits - 1, 5000, dtype=np.uint64) & ~np.uint64(((1 << 20) - 1) << (bits // 3)))
    values = rng.integers(1, 60000, len(keys)).astype("<u8" if bits == 64 else "<u2")
    trie = Trie(memoryview(Trie.build(keys, values, fields)))
    asked = np.concatenate([keys, keys ^ np.uint64(4), rng.integers(0, 2**bits - 1, 3000, dtype=np.uint64)])
    found, got = trie(asked)
    table = dict(zip(keys.tolist(), values.tolist(), strict=True))
    assert got.tolist() == [table.get(k, 0) for k in asked.tolist()] and found.tolist() == [k in table for k in asked.tolist()]
    assert not Trie(Trie.build(keys[:0], values[:0], fields))(asked)[0].any()


def test_elias_fano():
    rng = np.random.default_rng(5)
    for n, top in ((0, 9), (1, 0), (7, 3), (900, 60), (900, 1 << 41), (900, 2**64 - 1)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        e = EliasFano(EliasFano.build(v))
        assert (e[np.arange(n)] == v).all()
        q = np.concatenate([v, rng.integers(0, top, 300, dtype=np.uint64, endpoint=True)])
        at, hit = e.successor(q)
        assert (at == np.searchsorted(v, q)).all() and (hit == np.isin(q, v)).all()


def test_packs():
    for arrays in ([], [np.zeros(0, "<u8")], [np.array([1, 5], "<u8"), np.array([7], "<u2"), np.zeros(0, "<u1")]):
        assert [a.tolist() for a in L.unpacked(L.packed(arrays))] == [a.tolist() for a in arrays]
