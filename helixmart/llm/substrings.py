"""Repeated passages by recompression of word sequences.

Two rounds rename the words of every text: a run of exactly two equal symbols becomes one symbol, then neighbours
of which the first is a left and the second a right symbol (by a bit of their name) become one. A name is the
hash of what it stands for, so every task gives the same run or pair the same name. What happens to a symbol is
decided by its neighbours only: in two texts that share ``WINDOW`` words, the symbols that lie at least
``MARGIN`` words inside are the same, and a symbol covers ``2 * 2`` words at most, so every window holds one
whole. The one with the smallest name is the window's symbol; with the words around it that decided it, it
gets a name of the next level.

Symbols that occur in one document only are dropped first: they travel as 32 bits each, packed by chunk of
documents and bucket of names. Only windows whose symbol is shared travel as 96-bit digests of their words; the
smallest document of each digest decides what is removed. Answers come back as one bit per symbol or window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixmart.llm.common import (
    CHUNK_POSTINGS, CHUNK_ROWS, MULTIPLIERS, by_bucket, encoded, mixed, repeated, shuffle_buckets, stored, table,
    text_batches, window_hashes, word_hashes,
)

WINDOW, MARGIN = 13, 3

_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("rows", pa.binary()),
                     ("docs", pa.list_(pa.int64())), ("bits", pa.binary()), ("ids", pa.list_(pa.int64())), ("ties", pa.list_(pa.int64()))])
_DDL = ("bucket int, chunk long, keys binary, more binary, rows binary, docs array<long>, bits binary, ids array<long>, "
        "ties array<long>")
_LAST = np.iinfo(np.int64).max


def recompressed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round of runs and one of pairs over the names ``h``: names, starts and ends (exclusive) in ``h``."""
    n = len(h)
    start = np.arange(n)
    if n < 2:
        return h, start, start + 1
    same = h[1:] == h[:-1]
    # A run of exactly two: equal to the next, not to the one before or after.
    first = np.zeros(n, bool)
    first[:-1] = same
    first[1:] &= ~same
    first[:-2] &= ~same[1:]
    names = np.where(first, mixed(h * MULTIPLIERS[1] + np.uint64(2)), h)
    keep = np.ones(n, bool)
    keep[1:] = ~first[:-1]
    names, start = names[keep], start[keep]
    left = (mixed(names) & np.uint64(1)).astype(bool)
    pair = np.zeros(len(names), bool)
    pair[:-1] = left[:-1] & ~left[1:]
    joint = names.copy()
    joint[:-1] = np.where(pair[:-1], mixed(names[:-1] * MULTIPLIERS[0] + names[1:]), names[:-1])
    keep = np.ones(len(names), bool)
    keep[1:] = ~pair[:-1]
    names, start = joint[keep], start[keep]
    return names, start, np.append(start[1:], n)


def window_symbols(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the symbols that some window chooses, and for every window which of them (as an index). A name
    stands for the symbol with MARGIN words on either side, which every window that chooses it holds as well, so
    short symbols of common words are not shared by chance."""
    count = len(h) - WINDOW + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    names, start, end = recompressed(h)
    # Windows w with w + MARGIN <= start and end <= w + WINDOW - MARGIN see the symbol.
    low, high = np.maximum(end - (WINDOW - MARGIN), 0), np.minimum(start - MARGIN, count - 1)
    # Symbols write themselves to all their windows from the largest name down, so the smallest name stays.
    order = np.argsort(names, kind="stable")[::-1]
    w = low[order, None] + np.arange(WINDOW - 2 * MARGIN)
    seen = w <= high[order, None]
    chosen = np.zeros(count, np.int64)
    chosen[w[seen]] = np.broadcast_to(order[:, None], w.shape)[seen]
    used, index = np.unique(chosen, return_inverse=True)
    around = window_hashes(h, 1 + 2 * MARGIN)
    first, last = around[start[used] - MARGIN], around[end[used] - MARGIN - 1]
    return mixed((names[used] * MULTIPLIERS[0] + first) * MULTIPLIERS[1] + last), index


def _table(rows: list[tuple]) -> pa.Table:
    if not rows:
        return _SCHEMA.empty_table()
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


class _Chunks:
    """Packs the sorted keys of a task's documents by chunk and bucket. A bucket is a range of keys, so a
    document's answers, put together bucket by bucket, follow the order of its keys."""

    def __init__(self, buckets: int):
        self.buckets, self.seq, self.docs, self.n = buckets, 0, [], 0

    def add(self, doc_id, tie, keys: np.ndarray, more: np.ndarray | None = None):
        self.docs.append((doc_id, tie, keys, more))
        self.n += len(keys)
        if self.n >= CHUNK_POSTINGS or len(self.docs) >= CHUNK_ROWS:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        docs, self.docs, self.n = self.docs, [], 0
        chunk = (TaskContext.get().partitionId() << 32) + self.seq
        self.seq += 1
        keys = np.concatenate([d[2] for d in docs])
        rows = np.repeat(np.arange(len(docs), dtype=np.uint16), [len(d[2]) for d in docs])
        order, starts = by_bucket(keys, self.buckets)
        more = None if docs[0][3] is None else np.concatenate([d[3] for d in docs])[order]
        keys, rows = keys[order], rows[order]
        out = []
        for b, (s, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            if e > s and more is None:
                out.append((b, chunk, keys[s:e].astype(np.uint32).tobytes(), None, rows[s:e].tobytes(), None, None, None, None))
            elif e > s:
                held = [docs[r][0] for r in np.unique(rows[s:e]).tolist()]
                out.append((b, chunk, keys[s:e].tobytes(), more[s:e].tobytes(), rows[s:e].tobytes(), held, None, None, None))
        out.append((chunk % self.buckets, chunk, None, None, None, None, None, [d[0] for d in docs], [d[1] for d in docs]))
        return _table(out).combine_chunks().to_batches()[0]


def _replies(t: pa.Table, masks) -> pa.Table:
    """The senders' row numbers with one bit per key, and the chunks' own rows passed on."""
    out = [(b, c, None, None, r, None, np.packbits(m).tobytes(), None, None) for b, c, r, m in zip(
        *[t[n].to_pylist() for n in ("bucket", "chunk", "rows")], masks, strict=True)]
    return _table(out)


def _shared(t):
    """Which keys of a bucket several documents hold."""
    meta, t = t.filter(t["ids"].is_valid()), t.filter(t["keys"].is_valid())
    parts = [np.frombuffer(x.as_py(), np.uint32) for x in t["keys"]]
    mask = repeated(np.concatenate(parts)) if parts else np.empty(0, bool)
    return pa.concat_tables([meta.cast(_SCHEMA), _replies(t, np.split(mask, np.cumsum([len(p) for p in parts])[:-1]) if parts else [])])


def _later(t):
    """Which windows of a bucket also start in a document of smaller id; null ids come last."""
    meta, t = t.filter(t["ids"].is_valid()), t.filter(t["keys"].is_valid())
    if not t.num_rows:
        return meta.cast(_SCHEMA)
    keys, more, docs = [], [], []
    for k, m, r, ids in zip(*[t[n].to_pylist() for n in ("keys", "more", "rows", "docs")], strict=True):
        keys.append(np.frombuffer(k, np.uint64))
        more.append(np.frombuffer(m, np.uint32))
        _, own = np.unique(np.frombuffer(r, np.uint16), return_inverse=True)
        docs.append(np.array([_LAST if i is None else i for i in ids], np.int64)[own])
    k, m, d = np.concatenate(keys), np.concatenate(more), np.concatenate(docs)
    order = np.lexsort((m, k))
    k, m = k[order], m[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    least = np.minimum.reduceat(d[order], np.flatnonzero(new))
    late = np.empty(len(k), bool)
    late[order] = d[order] > least[np.cumsum(new) - 1]
    return pa.concat_tables([meta.cast(_SCHEMA), _replies(t, np.split(late, np.cumsum([len(x) for x in keys])[:-1]))])


def _per_document(t):
    """The bits of each document of a chunk, in the order of its keys, for documents with any bit set."""
    meta = t.filter(t["ids"].is_valid())
    ids, ties = meta["ids"][0].as_py(), meta["ties"][0].as_py()
    t = t.filter(t["bits"].is_valid()).sort_by("bucket")
    rows = [np.frombuffer(r, np.uint16) for r in t["rows"].to_pylist()]
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(r)) for b, r in zip(t["bits"].to_pylist(), rows, strict=True)]
    rows, bits = np.concatenate(rows or [np.empty(0, np.uint16)]), np.concatenate(bits or [np.empty(0, np.uint8)])
    per = np.split(bits[np.argsort(rows, kind="stable")], np.cumsum(np.bincount(rows, minlength=len(ids)))[:-1])
    some = [i for i, b in enumerate(per) if b.any()]
    return pa.table({"doc_id": pa.array([ids[i] for i in some], pa.int64()), "tie": pa.array([ties[i] for i in some], pa.int64()),
                     "flags": pa.array([np.packbits(per[i]).tobytes() for i in some], pa.binary())})


def _asked(packed: DataFrame, decide) -> DataFrame:
    """(doc_id, tie, flags): what ``decide`` says of the packed keys; equal rows have equal flags and come once."""
    replies = packed.groupBy("bucket").applyInArrow(decide, _DDL)
    flags = replies.groupBy("chunk").applyInArrow(_per_document, "doc_id long, tie long, flags binary")
    return stored(flags.dropDuplicates(["doc_id", "tie"]))


def _of_shared_symbol(h: np.ndarray, flags: bytes) -> np.ndarray:
    """Starts of the windows whose symbol is shared, by their key, and the keys. ``flags`` follow the sorted
    distinct symbols of the document."""
    names, index = window_symbols(h)
    distinct, place = np.unique(names, return_inverse=True)
    shared = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(distinct)).astype(bool)
    at = np.flatnonzero(shared[place][index])
    keys = window_hashes(h, WINDOW)[at]
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def _met(docs: DataFrame, flags: DataFrame, name: str, how: str) -> DataFrame:
    flags = flags.toDF("_id", "_tie", name)
    return docs.join(flags, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), how).drop("_id", "_tie")


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, text (the words that stay, joined by
    a space).

    A word falls away when a window of WINDOW words that covers it also starts in a document of smaller doc_id.
    Windows are judged on the input. Rows of one doc_id never remove from each other; a null doc_id counts as
    larger than all. Null texts have no words; texts with fewer words than a window keep them all; an empty table
    gives no rows.
    """
    buckets = shuffle_buckets(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")

    def symbols(batches):
        chunks = _Chunks(buckets)
        for doc_id, tie, text in text_batches(batches, ["doc_id", "tie", "text"], "words"):
            names, _ = window_symbols(word_hashes(encoded(text).split()))
            if len(names):
                yield from chunks.add(doc_id, tie, np.unique(names))
        if chunks.docs:
            yield chunks.flush()

    shared = _asked(docs.mapInArrow(symbols, _DDL), _shared)

    def windows(batches):
        chunks = _Chunks(buckets)
        for doc_id, tie, text, flags in text_batches(batches, ["doc_id", "tie", "text", "flags"], "words"):
            h = word_hashes(encoded(text).split())
            at, keys = _of_shared_symbol(h, flags)
            yield from chunks.add(doc_id, tie, keys, (window_hashes(h, WINDOW, 1)[at] >> np.uint64(32)).astype(np.uint32))
        if chunks.docs:
            yield chunks.flush()

    late = _asked(_met(docs, shared, "flags", "inner").mapInArrow(windows, _DDL), _later)

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, text, flags, bits in text_batches([batch], ["doc_id", "text", "flags", "late"], "words"):
                words = encoded(text).split()
                n, gone = len(words), 0
                if bits is not None:
                    h = word_hashes(words)
                    at, _ = _of_shared_symbol(h, flags)
                    starts = at[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)]
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, starts, 1)
                    np.add.at(depth, starts + WINDOW, -1)
                    keep = np.cumsum(depth[:-1]) == 0
                    gone = n - int(keep.sum())
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                out.append((doc_id, n, gone, b" ".join(words).decode("utf-8", "surrogatepass")))
                if len(out) == 256:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    both = _met(shared, late.withColumnRenamed("flags", "late"), "late", "inner")
    flagged = docs.join(both.toDF("_id", "_tie", "flags", "late"),
                        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    return flagged.select("doc_id", "text", "flags", "late").mapInArrow(cut, "doc_id long, n_words long, n_removed long, text string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                      ["doc_id", "n_words", "n_removed", "text"])


def op8_substrings(spark: SparkSession, folder: str) -> DataFrame:
    kept = without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
