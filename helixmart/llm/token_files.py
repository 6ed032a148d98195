"""Token ids in raw shard files, with a minimal perfect hash index from document key to its ids.

Documents are dealt out by ranges of (doc_id, text hash) and sorted, so shard after shard holds the ids in
ascending doc_id order. Each task writes one ``.bin`` file (ids only, little-endian, 16 bit while the vocabulary
allows it) and one ``.idx`` file (minimal perfect hash, and per slot a fingerprint, offset and count). Files are
written under a name of the attempt and then renamed, so a repeated task leaves the same files.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from helixmart.llm.common import mixed, pick, shared_dir, stored, table, text_batches
from helixmart.llm.tokens import encoder

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Words that a worker remembers in each generation, beside shards of its own and of other tasks in the executor.
WORDS = 150_000
#: Slots per key and level of the hash, and levels before the rest is listed.
GAMMA, LEVELS = 2.0, 24


class MinimalPerfectHash:
    """Maps n distinct 64-bit keys to 0..n-1 without storing them (levels of bit arrays, Limasset et al. 2017).

    A key takes its slot at the first level where no other remaining key wants the same one; its number is the
    count of slots taken before. Keys that meet at every level are listed. A key that was never put in may get a
    number or -1: fingerprints tell.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        sizes, taken, left = [], [], keys
        while len(left) and len(sizes) < LEVELS:
            size = max(1, int(GAMMA * len(left)))
            slot = cls._slot(left, len(sizes), size)
            bits = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            taken.append(bits)
            left = left[~bits[slot]]
        return cls(np.array(sizes, np.int64), np.concatenate([*taken, np.empty(0, bool)]), np.sort(left))

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            slot = self.starts[level] + self._slot(keys[left], level, size)
            hit = self.bits[slot]
            found[left[hit]] = self.ranks[slot[hit]]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            found[left[hit]] = self.ranks[-1] + at[hit]
        return found


def key_hashes(ids: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray, seed: int) -> np.ndarray:
    """64 bits per (doc_id or null, occurrence)."""
    h = mixed(mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(seed)) + nulls.astype(np.uint64))
    return mixed(h + occurrence.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """Keyed access to one written shard."""

    def __init__(self, folder: str, shard: int):
        self.fs, root = FileSystem.from_uri(folder)
        self.data = f"{root}/shard-{shard:06d}.bin"
        with self.fs.open_input_file(f"{root}/shard-{shard:06d}.idx") as f:
            a = dict(np.load(io.BytesIO(f.read())))
        self.hash = MinimalPerfectHash(a["sizes"], np.unpackbits(a["bits"], count=int(a["n_bits"])).astype(bool), a["rest"])
        self.prints, self.offsets, self.counts, self.seed = a["prints"], a["offsets"], a["counts"], int(a["seed"])
        self.width, self.file = int(a["width"]), None

    def find(self, ids: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the shard does not hold it."""
        keys = key_hashes(ids, nulls, occurrence, self.seed)
        slot = self.hash(keys)
        good = slot >= 0
        good[good] = self.prints[slot[good]] == fingerprints(keys[good])
        return np.where(good, slot, -1)

    def read(self, slot: int) -> np.ndarray:
        """The ids of a slot as unsigned 32-bit numbers: one read at a known place."""
        if self.file is None:
            self.file = self.fs.open_input_file(self.data)
        raw = self.file.read_at(int(self.counts[slot]) * self.width, int(self.offsets[slot]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        at = self.find(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([occurrence]))[0]
        return None if at < 0 else self.read(at)


def occurrences(ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each row of a sorted key column."""
    n = len(ids)
    new = np.ones(n, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])
    starts = np.flatnonzero(new)
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def _write_shard(rows: Iterator[tuple], folder: str, path: str, end_id: int) -> tuple[int, int, int, int | None, int | None]:
    enc, (fs, root), shard = encoder(path, WORDS), FileSystem.from_uri(folder), TaskContext.get().partitionId()
    fs.create_dir(root, recursive=True)
    width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 65536 else 4
    end = end_id.to_bytes(4, "little")
    ids, nulls, counts = [], [], []
    part = f"{root}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{part}.bin") as out:
        for doc_id, text in rows:
            tokens = np.frombuffer(enc.encode(text) + end, "<u4").astype(f"<u{width}")
            out.write(tokens.tobytes())
            ids.append(doc_id or 0)
            nulls.append(doc_id is None)
            counts.append(len(tokens))
    fs.move(f"{part}.bin", f"{root}/shard-{shard:06d}.bin")
    ids, nulls, counts = np.array(ids, np.int64), np.array(nulls, bool), np.array(counts, np.int64)
    occurrence, seed = occurrences(ids, nulls), 0
    keys = key_hashes(ids, nulls, occurrence, seed)
    while len(np.unique(keys)) < len(keys):
        seed += 1
        keys = key_hashes(ids, nulls, occurrence, seed)
    mph = MinimalPerfectHash.build(keys)
    slot = mph(keys)
    prints, offsets, lengths = np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    prints[slot], lengths[slot] = fingerprints(keys), counts
    offsets[slot] = np.cumsum(counts) - counts
    index = io.BytesIO()
    np.savez(index, sizes=mph.sizes, bits=np.packbits(mph.bits), n_bits=len(mph.bits), rest=mph.rest, prints=prints,
             offsets=offsets, counts=lengths, seed=seed, width=width)
    with fs.open_output_stream(f"{part}.idx") as out:
        out.write(index.getvalue())
    fs.move(f"{part}.idx", f"{root}/shard-{shard:06d}.idx")
    return shard, len(ids), int(counts.sum()), None if nulls[0] else int(ids[0]), None if nulls[-1] else int(ids[-1])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write the files of ``docs`` (doc_id, text) below ``folder``; returns the manifest (shard, n_docs, n_tokens,
    first_id, last_id, start), one row per shard: the bounds lead from a key to its shard.

    Null and empty texts hold the end id alone; null doc_ids come first. Rows of one doc_id are told apart by
    their place among equal keys of a shard; they are dealt out by their text's hash too, so a repeated doc_id
    does not fill one shard unless its texts are equal as well. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        rows = text_batches(batches, ["doc_id", "text"], "encoders")
        first = next(rows, None)
        if first is not None:
            def again():
                yield first
                yield from rows

            row = _write_shard(again(), folder, tokenizer, end_id)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], ["shard", "n_docs", "n_tokens", "first_id", "last_id"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    dealt = keyed.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "tie")
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    manifest = stored(dealt.select("doc_id", "text").mapInArrow(write, "shard long, n_docs long, n_tokens long, first_id long, last_id long"))
    # One row per shard, so this window is as small as a list of the files.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Bounds:
    """The shards' key ranges, from the manifest: as many entries as files. Null keys come before all others."""

    def __init__(self, manifest: DataFrame):
        rows = sorted(manifest.collect(), key=lambda r: r["shard"])
        self.shards = np.array([r["shard"] for r in rows], np.int64)
        self.starts = {r["shard"]: r["start"] for r in rows}
        # Keys as floats would lose bits: a null sorts below through a key of its own.
        self.first = np.array([(r["first_id"] is not None, r["first_id"] or 0) for r in rows], self.KEY)
        self.last = np.array([(r["last_id"] is not None, r["last_id"] or 0) for r in rows], self.KEY)

    KEY = np.dtype([("known", "?"), ("id", "<i8")])

    def spans(self, ids: np.ndarray, nulls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) place of the shards that can hold each key, by bisection."""
        keys = np.empty(len(ids), self.KEY)
        keys["known"], keys["id"] = ~nulls, np.where(nulls, 0, ids)
        return np.searchsorted(self.last, keys, "left"), np.searchsorted(self.first, keys, "right")


class TokenFiles:
    """Keyed access over all shards: the bounds name the shard, its minimal perfect hash the place."""

    def __init__(self, manifest: DataFrame, folder: str):
        self.bounds, self.folder, self.opened = Bounds(manifest), folder, {}

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this key; none if there is no such key."""
        low, high = self.bounds.spans(np.array([doc_id or 0]), np.array([doc_id is None]))
        found = []
        for shard in self.bounds.shards[low[0] : high[0]].tolist():
            if shard not in self.opened:
                self.opened[shard] = Shard(self.folder, shard)
            occurrence = 0
            while (ids := self.opened[shard].get(doc_id, occurrence)) is not None:
                found.append(ids)
                occurrence += 1
        return found


def read_token_files(manifest: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """Fetch the documents of all ``keys`` (doc_id) through the index: doc_id, start, n_tokens, ids_crc32, shard. A key that
    several documents share gives a row for each; a key without document gives none."""
    bounds = Bounds(manifest)

    def locate(batches):
        for batch in batches:
            ids = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            nulls = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            low, high = bounds.spans(ids, nulls)
            n = np.maximum(high - low, 0)
            at = np.repeat(np.arange(len(ids)), n)
            place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at]
            yield pa.RecordBatch.from_arrays([pa.array(bounds.shards[place]), batch["doc_id"].take(pa.array(at))], ["shard", "doc_id"])

    def read(batches):
        s, now = None, -1
        for batch in batches:
            shards = batch["shard"].to_numpy()
            for shard in np.unique(shards).tolist():
                if shard != now:
                    s, now = Shard(folder, shard), shard
                own = batch["doc_id"].filter(pa.array(shards == shard))
                ids, nulls = own.fill_null(0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False)
                left, occurrence = np.arange(len(ids)), 0
                while len(left):
                    slots = s.find(ids[left], nulls[left], np.full(len(left), occurrence))
                    left, slots, occurrence = left[slots >= 0], slots[slots >= 0], occurrence + 1
                    # In the order of the file, so reads run forward.
                    order = np.argsort(s.offsets[slots])
                    left, slots = left[order], slots[order]
                    for at in range(0, len(left), 4096):
                        part, rows = slots[at : at + 4096], left[at : at + 4096]
                        crc = [zlib.crc32(s.read(i).tobytes()) for i in part.tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[rows], pa.int64(), mask=nulls[rows]), pa.array(bounds.starts[shard] + s.offsets[part], pa.int64()),
                             pa.array(s.counts[part], pa.int64()), pa.array(crc, pa.int64()), pa.array([shard] * len(part), pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(locate, "shard long, doc_id long")
    # A task takes a few shards, one after the other.
    dealt = asked.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "doc_id")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Write the ids of all documents and look every doc_id of the table up in the files."""
    target = shared_dir(spark)
    docs = pick(table(spark, folder, "documents"), "doc_id", "text")
    return read_token_files(write_token_files(docs, target, public_tokenizers.path(TOKENIZER)), target, docs.select("doc_id"))
