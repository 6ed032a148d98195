import random
import re

import pytest

from helixmart.llm import jaccard as J

SCHEMA = "doc_id long, text string, n long"


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """doc row -> (set size, smallest doc_id of its component)."""
    sets = [sets_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= 80 * len(sets[a] | sets[b]):
                old = group[a]
                group = [group[b] if g == old else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group, strict=True):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return sorted((doc is None, doc or 0, len(s), str(least.get(g, doc))) for (doc, _), s, g in zip(rows, sets, group, strict=True))


def link_numbers(rows):
    """doc row -> (set size, rows that it links with), by all pairs."""
    sets = [sets_of(t) for _, t in rows]
    linked = [sum(a != b and bool(s) and 100 * len(s & z) >= 80 * len(s | z) for b, z in enumerate(sets)) for a, s in enumerate(sets)]
    return sorted((doc is None, doc or 0, len(s), n) for (doc, _), s, n in zip(rows, sets, linked, strict=True))


def got(frame):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, str(r.component_id)) for r in frame.collect())


def edited(rng, words, share):
    return [rng.choice("qwxyz") + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 150))]
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            texts.append(edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.05])))
    hub = [rng.choice(vocabulary) for _ in range(120)]
    texts += [edited(rng, hub, rng.choice([0.01, 0.02, 0.04])) for _ in range(80)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts += [[rng.choice(vocabulary) for _ in range(60)] + passage for _ in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


ODD = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "One"), (1005, "one two"), (1006, "a a a a a a a a"), (1007, "A a a a a"),
       (1008, "Ä b c d e"), (1009, "ä b c d e"), (1010, "x y z"), (None, "one two"), (None, "no id here at all"), (1003, "other words of one id now"),
       (1003, "one"), (1011, "long text " * 20_000)]


@pytest.mark.parametrize(("seed", "block"), [(1, 2048), (2, 16), (3, 40)])
def test_against_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(J, "BLOCK_DOCS", block)
    rows = corpus(seed) + ODD
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA)
    frame = J.jaccard_groups(docs, count_links=True)
    assert got(frame) == brute(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.n_links) for r in frame.collect()) == link_numbers(rows)


def test_limits_are_exact():
    for a in range(1, 60):
        for b in range(1, 60):
            i = J.needed(a, b)
            assert 100 * i >= 80 * (a + b - i) and 100 * (i - 1) < 80 * (a + b - (i - 1))


def test_empty_table(spark):
    assert J.jaccard_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_op3_over_the_table(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert got(J.op3_jaccard(spark, tiny)) == brute(rows)
