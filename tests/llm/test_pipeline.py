from collections import defaultdict

import pytest

import corpus_pipeline as C
from helixmart.llm import toxicity as T
from helixmart.llm.packing import pack
from test_decontaminate import D
from test_jaccard import sets_of
from test_secrets import brute as base_spans
from test_tokens import check_pieces


def columns(df):
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


@pytest.fixture(scope="module")
def steps(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    out = [docs]
    for _, stage in C.STAGES:
        docs = stage(spark, docs, tiny)
        docs = C.stored(docs)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(steps):
    assert len(C.STAGES) == 5 and all(columns(s) == columns(steps[0]) for s in steps[1:5])


def test_toxic_documents_go(spark, tiny, steps):
    before, after = rows(steps[0]), rows(steps[1])
    labels = spark.read.parquet(f"{tiny}/labels.parquet").select("doc_id", "toxic").where(~T.fold(T.F.col("doc_id")))
    machine = T.train(steps[0], labels)
    assert set(after) == {i for i, r in before.items() if machine.score(T.features(r.text)) < 0.7}
    assert all(after[i] == before[i] for i in after)


def test_one_of_each_group_stays(steps):
    before, after = rows(steps[1]), rows(steps[2])
    sets = {i: sets_of(r.text) for i, r in before.items()}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            n = len(sets[a] & sets[b])
            if b < a and n and 100 * n >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    assert set(after) == set(group.values())


def test_contaminated_documents_go(spark, tiny, steps):
    before, after = rows(steps[2]), rows(steps[3])
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    found = {r.doc_id for r in D.contaminated(steps[2], bench).collect()}
    assert found and set(after) == set(before) - found


def test_secrets_are_blotted_out(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not base_spans(r.text)
        if not base_spans(before[i].text) and "[SECRET]" not in r.text:
            assert r == before[i]
        assert r.n_chars == len(r.text or "")


def test_kept_documents_are_packed(steps):
    check_pieces(steps[5].collect(), {i: r.text for i, r in rows(steps[4]).items()})


def test_run_is_the_stages(spark, tiny, steps):
    key = lambda r: (r.doc_id, r.start, r.length, r.sequence_id, r.offset)
    assert sorted(map(key, C.run(spark, tiny).collect())) == sorted(map(key, steps[5].collect()))


def test_repeated_odd_rows(spark, tiny):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int, tie long"
    text = "some words that are here and stay in one row of the table"
    docs = spark.createDataFrame([(1, text, "en", "s", 57, 1, 2)] * 3 + [(2, None, None, None, None, None, None)] * 2 + [(None, text, "en", "s", 57, 1, 2),
                                 (3, "", "", "", 0, 0, 0)], schema)
    counts = defaultdict(int)
    for r in C.drop_near_copies(spark, docs, tiny).collect():
        counts[r.doc_id] += 1
    assert counts == {1: 1, 2: 2, 3: 1}
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, tiny)
        assert docs.schema.simpleString() == docs.limit(0).schema.simpleString() and docs.columns[-2:] == ["extra", "tie"]
        assert stage(spark, docs.limit(0), tiny).count() == 0
    assert docs.count() == 4


def test_packing_remembers_few_words_and_packs_the_same(spark, tiny, steps, monkeypatch):
    asked = []
    monkeypatch.setattr(C, "pack", lambda docs, path, words=400_000: asked.append(words) or pack(docs, path, words=20))
    few = C.pack_sequences(spark, steps[4], tiny)
    assert asked[0] <= 100_000
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, few.collect()), key=key) == sorted(map(tuple, steps[5].collect()), key=key)
