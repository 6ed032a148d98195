"""Language-model scores from n-gram tries in Elias-Fano form.

Documents are cut into chunks of tokens, stored once. A chunk asks for each of its distinct n-grams, in sorted packs, one
per shard; the shard of an n-gram comes from the hash of all its words, so that no context, however common, meets one
task, and copies inside a chunk ask once. A shard adds up the training counts it receives, builds a trie over them
(levels of context-relative codes, monotone pointers, smoothed log frequencies in 16 bits), follows every asked path in
it and answers each chunk. Chunks then meet their answers and score their tokens.

The probability of a word is interpolated with its shorter context's, with a Dirichlet prior of the given strength:
P(w | c) = (count(cw) + strength * P(w | shorter c)) / (count(c) + strength). The shortest is the additive estimate, from
exact counts. A context's count is the frequency of a shorter n-gram of the same text, so a node needs no total of its
successors and hot contexts can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixmart.llm.common import encoded, mixed, stored, table, text_batches
from helixmart.llm.elias_fano import Trie

#: Words of an n-gram at most, and strength of the prior for n-grams of two, three, ... words.
ORDER, STRENGTH = 3, 100.0
#: Additive constant of the shortest estimate.
ADD = 0.1
#: Tokens of a chunk, and tokens whose n-grams one shard takes on average.
CHUNK_TOKENS, SHARD_KEYS = 9 << 17, 1 << 20
#: Bits of the codes by level: the path of an n-gram has 38 bits within its shard; single words have all 64.
FIELDS = {1: (64,), 2: (20, 18), 3: (14, 12, 12)}
PATH_BITS, SHARD_BITS = 38, 25
#: Quantised numbers: log10 in steps of 1/4096; 0 means "never seen".
STEPS = 4096
START, END = 0, 1

_ZSTD, _ZSTD_STORED = pa.Codec("zstd", compression_level=1), pa.Codec("zstd", compression_level=3)


def packed(arrays: list[np.ndarray], codec: pa.Codec = _ZSTD) -> bytes:
    """Arrays as byte planes, compressed: planes of sorted differences and of small numbers are mostly zeros."""
    head = np.array([len(arrays), *[v for a in arrays for v in (len(a), a.itemsize)]], "<u4").tobytes()
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return head + codec.compress(raw, asbytes=True) if raw else head


def unpacked(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    sizes = np.frombuffer(data, "<u4", 2 * n, 4).reshape(n, 2).tolist()
    total = sum(a * b for a, b in sizes)
    raw = np.frombuffer(_ZSTD.decompress(data[4 + 8 * n :], total) if total else b"", np.uint8)
    out, at = [], 0
    for length, width in sizes:
        out.append(np.ascontiguousarray(raw[at : at + length * width].reshape(width, length).T).view(f"<u{width}").reshape(length))
        at += length * width
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 256 else "<u2" if top < 65536 else "<u4" if top < 1 << 32 else "<u8")


def _sorted_pack(keys: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    gaps = keys.copy()
    gaps[1:] -= keys[:-1]
    return [gaps.astype("<u8"), _narrow(counts)]


class _Words(dict):
    """word -> its number in the chunk."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 2
        return n


class _Chunk:
    """Tokens of some texts, each text or part of one as a piece: the context it starts with, then its own tokens."""

    def __init__(self, order: int):
        self.order, self.words, self.streams, self.size = order, _Words(), [], 0
        self.pieces: list[tuple] = []

    def add(self, row: int, doc_id, train: bool, text: list[bytes], at: int, stop: int):
        """Words ``at`` to ``stop`` of a text, after as much context as the longest n-gram takes."""
        front = [self.words[w] for w in text[max(0, at - self.order + 1) : at]]
        if len(front) < max(1, self.order - 1) and len(front) == at:
            front.insert(0, START)
        end = stop == len(text)
        ids = np.fromiter(map(self.words.__getitem__, text[at:stop]), np.uint32, stop - at)
        stream = np.concatenate([np.array(front, np.uint32), ids, np.array([END] * end, np.uint32)])
        self.streams.append(stream)
        self.size += len(stream)
        self.pieces.append((row, doc_id, train, len(front), len(stream)))

    def batch(self, number: int) -> pa.RecordBatch:
        rows, ids, train, fronts, lengths = (list(c) for c in zip(*self.pieces, strict=True))
        stream = np.concatenate(self.streams)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        # Numbers by local frequency, so that their bytes compress well.
        order = np.argsort(-np.bincount(stream, minlength=len(hashes) + 2)[2:], kind="stable")
        rank = np.empty(len(order) + 2, np.uint32)
        rank[:2], rank[order + 2] = (START, END), np.arange(2, len(order) + 2)
        data = packed([rank[stream], hashes[order], _narrow(np.array(lengths)), np.array(fronts, "<u1"), np.array(train, "<u1")], _ZSTD_STORED)
        own = np.array(lengths) - np.array(fronts)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([int(own[np.array(train, bool)].sum())], pa.int64()), pa.array([len(stream)], pa.int64()),
             pa.array([rows], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64())), pa.array([data], pa.binary())],
            ["chunk", "train_tokens", "tokens", "rows", "doc_ids", "data"])


def chunked(docs: DataFrame, order: int = ORDER, size: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of ``docs`` (doc_id, text, train). A text that passes ``size`` is cut, and its parts keep their context."""

    def cut(batches):
        task, number, row, chunk = TaskContext.get().partitionId(), 0, 0, _Chunk(order)

        def full():
            nonlocal number, chunk
            out = chunk.batch((task << 32) + number)
            number, chunk = number + 1, _Chunk(order)
            return out

        for doc_id, text, train in text_batches(batches, ["doc_id", "text", "train"]):
            words, at = encoded(text).lower().split(), 0
            row += 1
            while True:
                stop = min(len(words), at + max(1, size - chunk.size))
                chunk.add((task << 32) + row, doc_id, train, words, at, stop)
                if chunk.size >= size:
                    yield full()
                if stop == len(words):
                    break
                at = stop
        if chunk.pieces:
            yield full()

    return docs.select("doc_id", "text", "train").mapInArrow(
        cut, "chunk long, train_tokens long, tokens long, rows array<long>, doc_ids array<long>, data binary")


def _fixed(n: int) -> int:
    return xxhash.xxh3_64_intdigest(b"start of text" if n == START else b"end of text")


class _Grams:
    """The n-grams of a stored chunk: per order the place each token's n-gram has among the chunk's distinct ones."""

    def __init__(self, data: bytes):
        self.x, hashes, lengths, fronts, train = unpacked(data)
        self.words = np.concatenate([np.array([_fixed(START), _fixed(END)], np.uint64), hashes])
        self.lengths, self.fronts, self.train = lengths.astype(np.int64), fronts.astype(np.int64), train.astype(bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.within = np.arange(len(self.x), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.lengths)
        own = self.within >= np.repeat(self.fronts, self.lengths)
        self.own, self.counted = own, own & np.repeat(self.train, self.lengths)

    def keys(self, n: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(where the n-grams end, distinct keys in order of shard and path, each n-gram's place among them, bounds of the
        shards among them); the upper bits of a key name its shard, but for single words, whose hash itself is in order
        of shards."""
        bounds = np.arange(shards + 1, dtype=np.uint64)
        if n == 1:
            # Distinct words are known, only their order is not.
            order = np.argsort(self.words, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            keys = self.words[order]
            edges = np.searchsorted((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), bounds)
            return np.arange(len(self.x), dtype=np.int32), keys, rank[self.x], edges
        at = np.flatnonzero(self.within >= n - 1).astype(np.int32)
        h = self.words[self.x[at - (n - 1)]]
        key = mixed(h) >> np.uint64(64 - FIELDS[n][0])
        for k, width in zip(range(n - 2, -1, -1), FIELDS[n][1:], strict=True):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += self.words[self.x[at - k]]
            h = mixed(h)
            key <<= np.uint64(width)
            key |= mixed(h) >> np.uint64(64 - width)
        h &= np.uint64(0xFFFFFFFF)
        h *= np.uint64(shards)
        key |= (h >> np.uint64(32)) << np.uint64(PATH_BITS)
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        place = np.empty(len(key), np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        key = key[new]
        return at, key, place, np.searchsorted(key, bounds << np.uint64(PATH_BITS))


def requests(chunks: DataFrame, orders: tuple[int, ...], shards: int) -> DataFrame:
    """(shard, chunk, data): per order the distinct keys a chunk asks the shard for, and how often it counts them itself."""

    def ask(batches):
        for batch in batches:
            for chunk, data in zip(batch["chunk"], batch["data"], strict=True):
                grams, parts = _Grams(data.as_py()), []
                for n in orders:
                    at, keys, place, edges = grams.keys(n, shards)
                    counts = np.bincount(place[grams.counted[at]], minlength=len(keys)).astype(np.uint64)
                    parts.append((keys if n == 1 else keys & np.uint64((1 << PATH_BITS) - 1), counts, edges))
                for low in range(0, shards, 256):
                    span = range(low, min(shards, low + 256))
                    blobs = [packed([a for keys, counts, e in parts for a in _sorted_pack(keys[e[s] : e[s + 1]], counts[e[s] : e[s + 1]])]) for s in span]
                    yield pa.RecordBatch.from_arrays([pa.array(span, pa.int32()), pa.array([chunk.as_py()] * len(span), pa.int64()), pa.array(blobs, pa.binary())],
                                                     ["shard", "chunk", "data"])

    return chunks.select("chunk", "data").mapInArrow(ask, "shard int, chunk long, data binary")


def quantised(counts: np.ndarray) -> np.ndarray:
    """1 + log10 in steps of 1/STEPS; 0 stays 0."""
    out = np.zeros(len(counts), "<u2")
    some = counts > 0
    out[some] = np.minimum(1 + np.rint(np.log10(counts[some].astype(float)) * STEPS), 65535)
    return out


def frequencies(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((codes.astype(float) - 1) / STEPS), 0.0)


def answers(asked: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    """(chunk, shard, orders, known, data): what the shard's tries hold for each key asked, in the order asked; known is
    the number of distinct n-grams of the first order that the shard has counts of (on one row per shard)."""

    def reply(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        blobs = [unpacked(b.as_py()) for b in t["data"]]
        out: list[list[np.ndarray]] = [[] for _ in blobs]
        known = 0
        for i, n in enumerate(orders):
            keys = [np.cumsum(b[2 * i], dtype=np.uint64) for b in blobs]
            together, place = np.unique(np.concatenate(keys), return_inverse=True)
            # Whole numbers below 2**53 stay exact in these sums.
            counts = np.bincount(place, np.concatenate([b[2 * i + 1] for b in blobs]).astype(float), len(together)).astype(np.uint64)
            seen = counts > 0
            trie = Trie(Trie.build(together[seen], counts[seen].astype("<u8") if n == 1 else quantised(counts[seen]), FIELDS[n]))
            _, held = trie(together)
            at = 0
            for reply_to, k in zip(out, keys, strict=True):
                reply_to.append(_narrow(held[place[at : at + len(k)]]))
                at += len(k)
            known += int(seen.sum()) if i == 0 else 0
        return pa.table({"chunk": t["chunk"], "shard": t["shard"], "first_order": pa.array([orders[0]] * len(blobs), pa.int32()),
                         "known": pa.array([known] + [0] * (len(blobs) - 1), pa.int64()), "data": pa.array([packed(o) for o in out], pa.binary())})

    return asked.groupBy("shard").applyInArrow(reply, "chunk long, shard int, first_order int, known long, data binary")


_SCORES = "row long, doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def scores(docs: DataFrame, order: int = ORDER, strength: float = STRENGTH, chunk_tokens: int = CHUNK_TOKENS, shards: int | None = None) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text, train) with a model of those whose train is true: doc_id, train, n_tokens,
    n_known, train_tokens, base_score, score.

    Tokens are the words of the text, A-Z in lower case, and one end. base_score adds up the additive estimate of each
    token from exact counts, score the interpolated n-gram probability. Null and empty texts hold the end alone. Rows of
    equal or null doc_id stay rows of their own; an empty table gives no rows, and without training rows every word is
    equally unknown. Columns beyond those named are ignored. Frequencies of n-grams are quantised to 1/4096 of a decade;
    paths have 38 bits within a shard, so two n-grams of one shard are taken for one with a chance of 2**-38 a pair.
    """
    spark = docs.sparkSession
    chunks = stored(chunked(docs, order, chunk_tokens))
    size = chunks.agg(F.sum("train_tokens").alias("t"), F.sum("tokens").alias("n")).first()
    total, tokens = size["t"] or 0, size["n"] or 0
    if shards is None:
        shards = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // SHARD_KEYS)), 1 << SHARD_BITS)
    words = stored(answers(requests(chunks, (1,), shards), (1,)))
    distinct = words.agg(F.sum("known")).first()[0] or 0
    paths = answers(requests(chunks, tuple(range(2, order + 1)), shards), tuple(range(2, order + 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {n: np.zeros(0) for n in range(1, order + 1)}
        for first in (1, 2):
            parts = [unpacked(b.as_py()) for b in right.filter(pc.equal(right["first_order"], first)).sort_by("shard")["data"]]
            for i, n in enumerate([1] if first == 1 else range(2, order + 1)):
                values = np.concatenate([p[i].astype(np.uint64) for p in parts])
                found[n] = values.astype(float) if n == 1 else frequencies(values)
        return _scored(left, found, shards, total, distinct, strength)

    asked = chunks.select("chunk", "rows", "doc_ids", "data").groupBy("chunk")
    held = words.drop("known").unionByName(paths.drop("known")).groupBy("chunk")
    parts = asked.cogroup(held).applyInArrow(meet, _SCORES)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("train").alias("train"), *sums).select(
        "doc_id", "train", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _scored(chunk: pa.Table, found: dict[int, np.ndarray], shards: int, total: int, distinct: int, strength: float) -> pa.Table:
    """Sums per piece of the chunk, from the frequency of each of its distinct n-grams."""
    grams = _Grams(chunk["data"][0].as_py())
    _, _, place, _ = grams.keys(1, shards)
    count = found[1][place]
    base = (count + ADD) / (total + ADD * (distinct + 1))
    # A text's start is as frequent as the end.
    ends = grams.words == np.uint64(_fixed(END))
    context = np.where(grams.x == START, found[1][np.flatnonzero(np.sort(grams.words) == grams.words[ends])[0]], count)
    p = base.copy()
    for n in range(2, len(found) + 1):
        at, _, place, _ = grams.keys(n, shards)
        own = found[n][place]
        p[at] = (own + strength * p[at]) / (context[at - 1] + strength)
        context.fill(0)
        context[at] = own
        del at, place, own

    def per_piece(a: np.ndarray) -> np.ndarray:
        return np.add.reduceat(a, grams.starts)

    return pa.table({
        "row": chunk["rows"].combine_chunks().flatten(), "doc_id": chunk["doc_ids"].combine_chunks().flatten(), "train": pa.array(grams.train),
        "n_tokens": per_piece(grams.own.astype(np.int64)), "n_known": per_piece((grams.own & (count > 0)).astype(np.int64)),
        "base_score": per_piece(np.where(grams.own, np.log10(base), 0.0)), "score": per_piece(np.where(grams.own, np.log10(p), 0.0))})


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id's text is 0 modulo 10; a null reads as the empty text, which is."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def op11_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held_out(F.col("doc_id"))).alias("train"))
    return scores(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
