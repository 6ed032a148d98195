import hashlib
import random
import re

import numpy as np
import pytest

from helixmart.llm import substrings as S

SCHEMA = "doc_id long, text string, flags string"


def brute(rows):
    first = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    order = lambda d: float("inf") if d is None else d
    for d, w in split:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(order(d), first.get(k, float("inf")))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < order(d):
                gone |= set(range(i, i + 13))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((str(d), len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in frame.collect())


def corpus(seed, vocabulary):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.randrange(10, 70))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = [word() for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            at = rng.randrange(len(words) + 1)
            words[at:at] = p[a : a + rng.randrange(5, 60)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(i + 500, t) for i, t in rows[:20]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "vocabulary"), [(1, 1000), (2, 2), (3, 5)])
def test_against_all_windows(spark, seed, vocabulary):
    long = "a b a a c " * 8000
    rows = corpus(seed, vocabulary) + [(2000, None), (2001, ""), (2002, "x " * 12), (2003, "x " * 13), (2004, "x " * 400), (2005, "x " * 14),
                                       (None, "x " * 20), (None, "w1 w2"), (2006, "É é é " * 9), (2007, "É é é " * 9), (2008, long),
                                       (2009, long), (2005, "x " * 14), (2005, "y " + "x " * 13)]
    docs = spark.createDataFrame([(d, t, "f") for d, t in rows], SCHEMA)
    assert got(S.without_repeats(docs)) == brute(rows)


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 10, 1000])
def test_every_window_has_a_symbol_and_equal_windows_the_same(vocabulary):
    rng = np.random.default_rng(vocabulary)
    names = rng.integers(0, 2**63, vocabulary).astype(np.uint64)
    seen = {}
    shared = names[rng.integers(0, vocabulary, 40)]
    for _ in range(60):
        around = [names[rng.integers(0, vocabulary, rng.integers(0, 9))] for _ in range(2)]
        h = np.concatenate([around[0], shared, around[1]])
        symbols, index = S.window_symbols(h)
        assert len(index) == len(h) - 12
        for w, i in enumerate(index.tolist()):
            assert seen.setdefault(h[w : w + 13].tobytes(), symbols[i]) == symbols[i]


def test_symbols_are_few():
    h = np.random.default_rng(1).integers(0, 2**63, 100_000).astype(np.uint64)
    assert len(S.window_symbols(h)[0]) < 0.4 * len(h)


def test_empty_table(spark):
    assert S.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_op8_over_the_table(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in S.op8_substrings(spark, tiny).collect()) == brute(rows)
