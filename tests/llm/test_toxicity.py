import random
import zlib

import numpy as np

from helixmart.llm import toxicity as T

SCHEMA = "doc_id long, text string, score string"


def corpus(n, seed):
    """Toxic are only texts with both an insult and a mention of a group."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"word{rng.randrange(200)}" for _ in range(rng.randrange(5, 60))]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        if insult:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "trash"]))
        if group:
            words.insert(rng.randrange(len(words)), rng.choice(["alphas", "betas", "gammas"]))
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_pairs_are_learnt():
    train, test = corpus(3000, 1), corpus(600, 2)
    y = np.array([r[2] for r in train], float)
    machine = T.FactorizationMachine(1 << T.BITS).fit([T.features(r[1]) for r in train], y, np.ones(len(y)), epochs=12)
    right = [(machine.score(T.features(t)) >= 0.5) == bool(label) for _, t, label in test]
    assert np.mean(right) > 0.97
    # Each word alone stays clean, the pair is toxic.
    score = lambda text: machine.score(T.features(text))
    assert score("some idiot") < 0.5 and score("all alphas") < 0.5 and score("idiot alphas") > 0.5


def test_odd_rows(spark):
    rows = corpus(300, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "idiot", None),
                                 (5, rows[5][1], "x"), (902, "long word1 " * 40_000, "x")], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    machine = T.train(docs, labels, rows=100)
    got = T.score(docs.drop("score"), machine).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (900, 901)}
    assert len(empty) == 1


def test_one_row_of_a_repeated_id_is_learnt(spark):
    rows = corpus(60, 4)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(7, f"other{n} text", "x") for n in range(200)] + [(8, rows[8][1], "x")] * 50, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in rows], "doc_id long, toxic int")
    x, y, weights = T.labelled_sample(docs, labels, rows=20)
    assert len(x) == len(y) == len(weights) == 40 and y.sum() == 20
    x, y, _ = T.labelled_sample(docs, labels, rows=100)
    assert len(x) == 60 and y.sum() == 30
    again = T.labelled_sample(docs.orderBy(T.F.desc("text")).repartition(7), labels, rows=100)[0]
    assert all((a == b).all() for a, b in zip(x, again, strict=True))


def test_nothing_to_learn_or_score(spark):
    docs = spark.createDataFrame([(1, "a text", "x")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    machine = T.train(docs, none)
    assert [r.score for r in T.score(docs.drop("score"), machine).collect()] == [0.5]
    assert T.score(docs.limit(0).drop("score"), machine).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in T.op4_toxicity(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())
    hits = sum(p and y for p, y in held)
    assert hits >= 0.8 * sum(y for _, y in held) and hits >= 0.98 * sum(p for p, _ in held)


def test_interactions_without_main_effects():
    """A row is toxic exactly when one of two words is in it: neither word, by itself, says anything."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        other = rng.choice(np.arange(10, 60), 5, replace=False)
        rows.append(np.sort(np.concatenate([np.flatnonzero([a, b]) + 1, other])).astype(np.int32))
        labels.append(float(a != b))
    labels = np.array(labels)
    machine = T.FactorizationMachine(64).fit(rows[:3000], labels[:3000], np.ones(3000), epochs=30)
    right = [(machine.score(x) >= 0.5) == y for x, y in zip(rows[3000:], labels[3000:], strict=True)]
    assert np.mean(right) > 0.95
    assert np.flatnonzero(machine.v.any(axis=1)).tolist() == [1, 2]


def test_noise_brings_no_features():
    rng = np.random.default_rng(6)
    rows = [np.sort(rng.choice(400, 20, replace=False)).astype(np.int32) for _ in range(3000)]
    machine = T.FactorizationMachine(400).fit(rows, (rng.random(3000) < 0.3).astype(float), np.ones(3000))
    assert machine.v.any(axis=1).sum() <= 5
