"""Helpers of the training-data operators: shared storage, word hashes, packed postings, components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixmart.session import scratch_dir

MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Postings in one chunk of documents, and documents in it (row numbers are 16 bit).
CHUNK_POSTINGS, CHUNK_ROWS = 400_000, 4096


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session of one process may do without the setting; it then takes a temporary folder.
    """
    return f"{scratch_dir(spark, 'llm')}/rows"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: it survives lost executors and has a known size."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_buckets(spark: SparkSession) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra columns and their names never matter."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Word tables that a worker remembers between tasks: name -> what empties it.
_REMEMBERED: dict[str, Callable[[], None]] = {}
_IN_USE: list[tuple[str, ...]] = [()]


def remembered(name: str, clear: Callable[[], None]) -> None:
    _REMEMBERED[name] = clear


def only(*names: str) -> None:
    """Workers live on from stage to stage: the first task of a stage with other word tables empties those of the last,
    so that a worker never holds more than one stage's."""
    if _IN_USE[0] != names:
        for name, clear in _REMEMBERED.items():
            if name not in names:
                clear()
        _IN_USE[0] = names
        pa.default_memory_pool().release_unused()


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, computed once per worker; emptied when full, so its memory is bounded."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


WORDS = WordHashes()
remembered("words", WORDS.clear)


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word. ``bytes.split()`` cuts at exactly the characters 0x20 and 0x09-0x0D."""
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_hashes(a: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values; empty when there are fewer."""
    n = len(a) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = a[:n].copy()
    for j in range(1, width):
        h *= MULTIPLIERS[lane]
        h += a[j : j + n]
    return mixed(h)


def text_batches(batches: Iterable[pa.RecordBatch], columns: list[str], *tables: str) -> Iterator[tuple]:
    """Rows of the batches, converted in slices so that few Python strings live at once; ``tables`` are the word tables
    that the task goes on to use."""
    only(*tables)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*[part.column(c).to_pylist() for c in columns], strict=True)


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts ``keys`` by bucket (keeping their order within it), and the buckets' starts in it.

    The bucket comes from the key's upper half, the 32 bits that travel from its lower half.
    """
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket.astype(np.uint16 if buckets < 65536 else np.uint32), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur at least twice."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    low = np.zeros(1 << 22, bool)
    cut = keys.dtype.type((1 << 22) - 1)
    low[twice & cut] = True
    mask = low[keys & cut]
    some = np.flatnonzero(mask)
    at = np.minimum(np.searchsorted(twice, keys[some]), len(twice) - 1)
    mask[some] = twice[at] == keys[some]
    return mask


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, component)`` with the smallest node as component.

    Alternates large-star and small-star steps (Kiveris et al. 2014). Every round is stored in the shared
    folder; edges of a hub are met by a join on their own node, so no node's neighbours form one group.
    Nodes without an edge to another node are left out.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(now):
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        now = stored(small.union(least.select(F.col("u"), F.col("m"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: Bits of a key filter, and of one of its pages: 8 MB on the driver and in a broadcast, whatever the corpus.
FILTER_BITS, PAGE_BITS = 26, 15


def maybe_in(key: Column, keys: DataFrame) -> Column:
    """False only where ``key`` (64-bit hash) is surely not among ``keys`` (one such column): rows that need no
    exact join are told apart before any shuffle. The filter has a fixed size; when very many keys fill it, more
    rows go through the exact join, and results stay the same."""
    name = keys.columns[0]
    place = F.shiftrightunsigned(F.col(name), 64 - FILTER_BITS)
    places = keys.select(F.shiftright(place, PAGE_BITS).cast("int").alias("page"), place.bitwiseAND((1 << PAGE_BITS) - 1).cast("int").alias("bit"))

    def fill(page, t):
        bits = np.zeros(1 << PAGE_BITS, np.uint8)
        bits[t["bit"].to_numpy()] = 1
        return pa.table({"page": pa.array([page[0].as_py()], pa.int32()), "bits": [np.packbits(bits).tobytes()]})

    filled = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for page, bits in places.distinct().groupBy("page").applyInArrow(fill, "page int, bits binary").collect():
        filled[page << (PAGE_BITS - 3) : (page + 1) << (PAGE_BITS - 3)] = np.frombuffer(bits, np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def hit(values: pd.Series) -> pd.Series:
        at = values.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - FILTER_BITS)
        return pd.Series((shared.value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool))

    return hit(key)


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most and those that have one are nobody's smaller neighbour."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def snake(name: str) -> str:
    return re.sub(r"\W+", "_", name).strip("_").lower()
