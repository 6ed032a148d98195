import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from helixmart.llm import tokens
from helixmart.llm.common import shared_dir
from helixmart.llm.packing import Mixture, op2_packing, pack
from helixmart.llm.token_files import MinimalPerfectHash, TokenFiles, op10_token_files, read_token_files, write_token_files
from helixmart.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array(WHOLE.encode(text or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t.,'aéßÑ<|>")), max_size=40))
def test_words_give_the_ids_of_the_text(text):
    if not hasattr(test_words_give_the_ids_of_the_text, "enc"):
        test_words_give_the_ids_of_the_text.enc = WordEncoder(PATH, limit=50)
    assert test_words_give_the_ids_of_the_text.enc.encode(text) == ids_of(text).tobytes()


def test_special_strings_and_other_files():
    enc = WordEncoder(PATH)
    for text in ["<|endoftext|>", "a <|startoftext|>b", "don't It's", "", "  "]:
        assert enc.encode(text) == ids_of(text).tobytes()


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_minimal_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    mph = MinimalPerfectHash.build(keys)
    assert sorted(mph(keys).tolist()) == list(range(len(keys)))


ROWS = [(3, "b one two", "s"), (1, None, None), (2, "", "s"), (None, "null id", "t"), (3, "another three", "t"), (3, "b one two", "s"),
        (9, "long " * 3000, "u")]
SCHEMA = "doc_id long, text string, source string"


def test_files_round_trip(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    folder = shared_dir(spark)
    manifest = write_token_files(docs, folder, PATH, shards=3)
    keys = docs.select("doc_id").union(spark.createDataFrame([(77,), (-5,)], "doc_id long"))
    got = sorted(read_token_files(manifest, folder, keys).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 3, 9]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    want = Counter((i, zlib.crc32(np.append(ids_of(t), 2).astype("<u4").tobytes())) for i, t, _ in ROWS)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    files = TokenFiles(manifest, folder)
    for key in (None, 1, 2, 3, 9):
        want = sorted([*ids_of(t).tolist(), 2] for i, t, _ in ROWS if i == key)
        assert sorted(ids.tolist() for ids in files.get(key)) == want
    assert files.get(12345) == files.get(-7) == files.get(4) == []


def test_a_key_opens_only_the_shards_of_its_range(spark):
    docs = spark.createDataFrame([(i * 3, f"text {i}", "s") for i in range(400)], SCHEMA)
    folder = shared_dir(spark)
    manifest = write_token_files(docs.selectExpr("*", "1 AS shard", "2 AS start"), folder, PATH, shards=8)
    files = TokenFiles(manifest, folder)
    assert manifest.count() > 4
    assert [ids.tolist() for ids in files.get(300)] == [[*ids_of("text 100").tolist(), 2]]
    assert files.get(301) == [] and len(files.opened) == 1


def test_files_of_an_empty_table(spark):
    folder = shared_dir(spark)
    manifest = write_token_files(spark.createDataFrame([], SCHEMA), folder, PATH)
    assert read_token_files(manifest, folder, spark.createDataFrame([(1,)], "doc_id long")).count() == 0
    assert TokenFiles(manifest, folder).get(1) == []


def test_op10_over_the_table(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    start = 0
    for r in sorted(op10_token_files(spark, tiny).collect(), key=lambda r: r.doc_id):
        ids = np.append(ids_of(texts.pop(r.doc_id)), 2).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not texts


def check_pieces(rows, texts, window=2048):
    """Every id in one piece, and sequences full without gaps but for the last."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids = np.append(ids_of(texts[doc]), 1).astype("<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for seq, parts in by_seq.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (seq == max(by_seq) and at < window)


def test_op2_over_the_table(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    check_pieces(op2_packing(spark, tiny).collect(), texts)


def test_odd_rows_are_packed(spark):
    rows = [(i, t, s) for i, (_, t, s) in enumerate(ROWS)]
    docs = spark.createDataFrame(rows, SCHEMA)
    check_pieces(pack(docs, PATH, window=64, quantum=8).collect(), {i: t for i, t, _ in rows}, 64)
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_windows_hold_the_target_mixture():
    """A queue's share of each window is within some quanta of its target, and phases follow empty queues."""
    rng = random.Random(1)
    totals = {0: 400_000, 1: 90_000, 2: 7_000, 5: 3}
    n = sum(totals.values())
    for weights in ({q: t / n for q, t in totals.items()}, {0: 0.25, 1: 0.25, 2: 0.25, 5: 0.25}):
        m = Mixture(totals, weights, 2048, 64)
        shares, covered = defaultdict(Counter), []
        for q, total in totals.items():
            cuts = sorted({0, total, *[rng.randrange(total) for _ in range(50)]})
            x0 = np.array(cuts[:-1])
            size = np.diff(cuts)
            span, start, length, place = m.pieces(q, x0, size)
            assert length.sum() == total
            for k, w in zip(length.tolist(), (place // 2048).tolist(), strict=True):
                shares[w][q] += k
            covered += [(p, p + k) for p, k in zip(place.tolist(), length.tolist(), strict=True)]
        covered.sort()
        assert covered[0][0] == 0 and covered[-1][1] == n and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
        if weights[0] > 0.5:
            for w in range(n // 2048):
                assert all(abs(shares[w][q] - 2048 * weights[q]) <= 4 * 64 for q in totals), (w, shares[w])
        else:
            assert all(abs(shares[w][q] - 2048 / 3) < 300 for w in range(3, 8) for q in (0, 1, 2))


def test_token_files_remember_fewer_words(monkeypatch):
    from helixmart.llm import token_files, tokens

    path = public_tokenizers.path(token_files.TOKENIZER)
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    enc = tokens.encoder(path, 50)
    text = " ".join(f"word{i % 170}" for i in range(1000))
    assert enc.encode(text) == tokens.WordEncoder(path).encode(text)
    for i in range(300):
        enc.encode(f"a{i} b{i}")
        assert len(enc.known) <= 53 or i == 0
    assert tokens.WordEncoder(path).limit > token_files.WORDS


def test_an_encoder_has_the_memory_that_its_caller_asks_for():
    path = public_tokenizers.path("word_bpe_49k.json")
    wide = tokens.encoder(path, 400_000)
    assert tokens.encoder(path, 400_000) is wide and tokens.encoder(path, 20).limit == 20
