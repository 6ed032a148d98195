"""Exact Jaccard self-join of documents on word shingles by T-occurrence search.

1. Every whole text becomes a set of shingle hashes; equal sets are one node. The shingles travel once, packed by
   chunk of documents and bucket of hashes, and what comes back is how many of a document's shingles occur
   elsewhere. A document with a partner shares at least 80 % of its shingles, so the others are done.
2. For the candidates, the lengths of all inverted lists are counted. A document enters only its shortest lists
   (as many as cannot all be missing in a partner). Documents that share one of these lists form a pool.
3. Pools are cut into blocks of bounded size. In a block, a query merges its short lists by counting, and probes
   its long lists by binary search for the documents that can still reach the overlap (DivideSkip). Pairs that are
   connected already are not looked at, so a group of copies costs links, not pairs. For pools of several blocks,
   the pool's hub is in every block, and the documents outside its largest group then meet all other blocks.
4. Connected components over the links give each document its group.

Where the number of links of every document is asked for, every pair of blocks of a pool is searched once, and each set
keeps a count of its partners, weighted by their copies; no pair is written down.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixmart.llm.common import (
    CHUNK_POSTINGS, CHUNK_ROWS, by_bucket, components, encoded, maybe_in, mixed, repeated, shuffle_buckets, stored, table,
    text_batches, window_hashes, word_hashes,
)

WIDTH, PERCENT = 5, 80
#: A block holds about so many documents and shingles at most.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 2_000_000

PACKED = "bucket int, chunk long, keys binary, counts binary, rows binary, ids array<long>, ties array<long>, sizes array<int>, digests binary"
_NAMES = ["bucket", "chunk", "keys", "counts", "rows", "ids", "ties", "sizes", "digests"]
_KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; with fewer words the whole sequence is one; without words none."""
    words = encoded(text).lower().split()  # bytes: lower() changes A-Z only
    h = word_hashes(words)
    if 0 < len(h) < width:
        return mixed(window_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(window_hashes(h, width))


def needed(a: int | np.ndarray, b: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """Smallest overlap i with 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], _NAMES)


class _Packer:
    """Collects sets of a task and yields them by (chunk, bucket)."""

    def __init__(self, buckets: int, whole_keys: bool):
        self.buckets, self.whole, self.n, self.seq, self.docs = buckets, whole_keys, 0, 0, []

    def add(self, doc_id, tie, hashes: np.ndarray, size: int, digest: bytes):
        self.docs.append((doc_id, tie, hashes, size, digest))
        self.n += len(hashes)
        if self.n >= CHUNK_POSTINGS or len(self.docs) >= CHUNK_ROWS:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        docs, self.docs, self.n = self.docs, [], 0
        chunk = (TaskContext.get().partitionId() << 32) + self.seq
        self.seq += 1
        keys = np.concatenate([d[2] for d in docs])
        rows = np.repeat(np.arange(len(docs), dtype=np.uint16), [len(d[2]) for d in docs])
        order, starts = by_bucket(keys, self.buckets)
        keys, rows = (keys if self.whole else keys.astype(np.uint32))[order], rows[order]
        out = [(b, chunk, keys[s:e].tobytes(), None, rows[s:e].tobytes(), None, None, None, None)
               for b, (s, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)) if e > s]
        out.append((chunk % self.buckets, chunk, None, None, None, [d[0] for d in docs], [d[1] for d in docs],
                    [d[3] for d in docs], b"".join(d[4] for d in docs)))
        return _batch(out)


def _empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


def shared_counts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each row of ``docs`` (doc_id, tie, text) as (doc_id, tie, n, digest, shared): the size of its shingle set, a
    128-bit digest of the set, and how many of its shingles other rows have as well (a few more by 32-bit chance)."""
    buckets = shuffle_buckets(docs.sparkSession)

    def pack(batches):
        packer = _Packer(buckets, False)
        for doc_id, tie, text in text_batches(batches, ["doc_id", "tie", "text"], "words"):
            s = shingles(text, width)
            yield from packer.add(doc_id, tie, s, len(s), xxhash.xxh3_128_digest(s.tobytes()))
        if packer.docs:
            yield packer.flush()

    def count(t):
        meta = t.filter(t["ids"].is_valid())
        t = t.filter(t["keys"].is_valid())
        out = [meta] if meta.num_rows else []
        if t.num_rows:
            parts = [np.frombuffer(x.as_py(), np.uint32) for x in t["keys"]]
            mask = repeated(np.concatenate(parts))
            at, rows = 0, []
            for chunk, part, row in zip(t["chunk"].to_pylist(), parts, t["rows"], strict=True):
                hit = np.frombuffer(row.as_py(), np.uint16)[mask[at : at + len(part)]]
                at += len(part)
                if len(hit):
                    n = np.bincount(hit)
                    some = np.flatnonzero(n)
                    rows.append((0, chunk, None, n[some].astype(np.uint32).tobytes(), some.astype(np.uint16).tobytes(), None, None, None, None))
            if rows:
                out.append(pa.Table.from_batches([_batch(rows)]))
        return pa.concat_tables([o.cast(pa.schema(list(zip(_NAMES, _KINDS, strict=True)))) for o in out]) if out else _empty(
            pa.schema(list(zip(_NAMES, _KINDS, strict=True))))

    def per_doc(t):
        meta = t.filter(t["ids"].is_valid())
        ids, ties, sizes = (meta[c][0].as_py() for c in ("ids", "ties", "sizes"))
        shared = np.zeros(len(ids), np.int64)
        for rows, n in zip(t["rows"].to_pylist(), t["counts"].to_pylist(), strict=True):
            if rows is not None:
                shared[np.frombuffer(rows, np.uint16)] += np.frombuffer(n, np.uint32)
        digests = meta["digests"][0].as_py()
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "tie": pa.array(ties, pa.int64()), "n": pa.array(sizes, pa.int64()),
                         "digest": [digests[i : i + 16] for i in range(0, len(digests), 16)], "shared": shared})

    packed = docs.select("doc_id", "tie", "text").mapInArrow(pack, PACKED)
    counted = packed.groupBy("bucket").applyInArrow(count, PACKED)
    return counted.groupBy("chunk").applyInArrow(per_doc, "doc_id long, tie long, n long, digest binary, shared long")


def short_lists(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, digest): for each set (digest, n, tokens) its shortest inverted lists, as many as a partner cannot
    miss all; lists of one set alone are left out but counted as missed."""
    buckets = shuffle_buckets(sets.sparkSession)

    def pack(batches):
        packer = _Packer(buckets, True)
        for digest, n, tokens in text_batches(batches, ["digest", "n", "tokens"], "words"):
            yield from packer.add(0, 0, np.frombuffer(tokens, np.uint64), n, digest)
        if packer.docs:
            yield packer.flush()

    def lengths(t):
        meta = t.filter(t["ids"].is_valid())
        t = t.filter(t["keys"].is_valid())
        out = [meta] if meta.num_rows else []
        if t.num_rows:
            parts = [np.frombuffer(x.as_py(), np.uint64) for x in t["keys"]]
            _, inverse, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            n = n[inverse].astype(np.uint32)
            at, rows = 0, []
            for chunk, part, row in zip(t["chunk"].to_pylist(), parts, t["rows"], strict=True):
                own = n[at : at + len(part)]
                at += len(part)
                many = own > 1
                if many.any():
                    row = np.frombuffer(row.as_py(), np.uint16)
                    rows.append((0, chunk, part[many].tobytes(), own[many].tobytes(), row[many].tobytes(), None, None, None, None))
            if rows:
                out.append(pa.Table.from_batches([_batch(rows)]))
        return pa.concat_tables([o.cast(pa.schema(list(zip(_NAMES, _KINDS, strict=True)))) for o in out]) if out else _empty(
            pa.schema(list(zip(_NAMES, _KINDS, strict=True))))

    def prefixes(t):
        meta = t.filter(t["ids"].is_valid())
        sizes = np.array(meta["sizes"][0].as_py(), np.int64)
        digests = meta["digests"][0].as_py()
        t = t.filter(t["keys"].is_valid())
        join = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in t[c]] or [np.empty(0, kind)])
        keys, n, rows = join("keys", np.uint64), join("counts", np.uint32), join("rows", np.uint16).astype(np.int64)
        order = np.lexsort((keys, n, rows))
        keys, rows = keys[order], rows[order]
        have = np.bincount(rows, minlength=len(sizes))
        rank = np.arange(len(rows)) - np.repeat(np.cumsum(have) - have, have)
        allowed = sizes - -(-percent * sizes // 100) + 1 - (sizes - have)
        took = rank < allowed[rows]
        return pa.table({"token": keys[took].view(np.int64), "digest": pa.array([digests[16 * i : 16 * i + 16] for i in rows[took].tolist()], pa.binary())})

    packed = sets.select("digest", "n", "tokens").mapInArrow(pack, PACKED)
    return packed.groupBy("bucket").applyInArrow(lengths, PACKED).groupBy("chunk").applyInArrow(prefixes, "token long, digest binary")


class Block:
    """T-occurrence search over the sets of one block, joining what links."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.n, self.percent = len(sets), percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        ends = np.cumsum(self.sizes)
        tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        docs = np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(inverse, kind="stable")
        self.lists, self.starts = docs[order], np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(tokens)))])
        self.postings = inverse[order] * self.n + self.lists  # sorted: binary search tells whether a list holds a set
        self.own = [inverse[e - s : e] for s, e in zip(self.sizes.tolist(), ends.tolist(), strict=True)]
        self.group, self.edges = np.arange(self.n), []

    def search(self, a: int, allowed: np.ndarray) -> np.ndarray:
        """The sets of ``allowed`` (mask) that reach the overlap with ``a``."""
        size = int(self.sizes[a])
        own = self.own[a]
        own = own[np.argsort((self.starts[own + 1] - self.starts[own]), kind="stable")]
        least = -(-self.percent * size // 100)
        short, long = own[: size - least + 1], own[size - least + 1 :]
        merged = np.concatenate([self.lists[self.starts[t] : self.starts[t + 1]] for t in short.tolist()])
        count = np.bincount(merged, minlength=self.n)
        allowed = allowed & (100 * np.minimum(self.sizes, size) >= self.percent * np.maximum(self.sizes, size))
        found = np.flatnonzero((count > 0) & allowed)
        count, want = count[found], needed(size, self.sizes[found], self.percent)
        if len(found) * len(long) * 16 > (self.starts[long + 1] - self.starts[long]).sum():
            # So many sets are left that merging the long lists too costs less than probing them.
            merged = np.concatenate([self.lists[self.starts[t] : self.starts[t + 1]] for t in long.tolist()])
            return found[count + np.bincount(merged, minlength=self.n)[found] >= want]
        for at in range(0, len(long), 64):
            alive = count + (len(long) - at) >= want
            found, count, want = found[alive], count[alive], want[alive]
            if not len(found):
                break
            probes = (long[at : at + 64, None] * self.n + found).ravel()
            place = np.minimum(np.searchsorted(self.postings, probes), len(self.postings) - 1)
            count = count + (self.postings[place] == probes).reshape(-1, len(found)).sum(axis=0)
        return found[count >= want]

    def join(self, a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            if self.group[a] != self.group[b]:
                self.edges.append((a, b))
                self.group[self.group == self.group[b]] = self.group[a]

    def link_all(self) -> list[tuple[int, int]]:
        """Links that connect whatever links connect. A pair within the largest group needs no look, and any other
        pair has a set outside of it, so only those sets have to search."""
        weight = np.array([(self.starts[o + 1] - self.starts[o]).sum() for o in self.own])
        done = np.zeros(self.n, bool)
        for a in np.argsort(-weight, kind="stable").tolist() * 2:
            largest = np.bincount(self.group).argmax()
            if done[a] or (self.group[a] == largest and done.any()):
                continue
            done[a] = True
            self.join(a, self.search(a, (self.group != self.group[a]) & ~done))
        largest = np.bincount(self.group).argmax()
        while len(left := np.flatnonzero((self.group != largest) & ~done)):
            done[left[0]] = True
            self.join(left[0], self.search(left[0], (self.group != self.group[left[0]]) & ~done))
            largest = np.bincount(self.group).argmax()
        return self.edges


    def partners(self, copies: np.ndarray, side: np.ndarray) -> np.ndarray:
        """For each set the copies of all sets that it links with: within the block where all have one ``side``, else
        only between the two sides."""
        found, whole = np.zeros(self.n, np.int64), len(np.unique(side)) < 2
        place = np.arange(self.n)
        for a in (place if whole else place[side == 0]).tolist():
            at = self.search(a, place > a if whole else side == 1)
            found[a] += copies[at].sum()
            found[at] += copies[a]
        return found


EDGES = "a binary, b binary"


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})


def _sets(t: pa.Table) -> tuple[list[bytes], list[np.ndarray]]:
    seen = dict(zip(t["digest"].to_pylist(), t["tokens"].to_pylist(), strict=True))
    return list(seen), [np.frombuffer(x, np.uint64) for x in seen.values()]


def pooled(sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(pools, sizes): the pool of each set that shares a short list with another, and each pool's number of blocks and
    hub. Linked sets are in one pool."""
    lists = stored(short_lists(sets, percent))
    heads = lists.groupBy("token").agg(F.min("digest").alias("a"), F.count("*").alias("k")).where("k > 1").select("token", "a")
    stars = stored(lists.join(heads, "token").where("a != digest").select("a", F.col("digest").alias("b")).distinct())
    pools = stored(components(stars).toDF("digest", "pool"))
    hubs = stars.groupBy("a").count().join(pools, F.col("a") == F.col("digest")).groupBy("pool").agg(
        F.max(F.struct("count", "a"))["a"].alias("hub"))
    # Both sides grow with the corpus, so these joins shuffle at every size.
    sizes = pools.join(sets.select("digest", "n").hint("merge"), "digest").groupBy("pool").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return pools, stored(sizes.join(hubs, "pool"))


def link_counts(sets: DataFrame, pools: DataFrame, sizes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(digest, linked): for each of ``sets`` (digest, copies, tokens) the documents of other sets that it links with; sets
    without any may be missing. Each two blocks of a pool meet in one task."""
    members = pools.join(sets.hint("merge"), "digest").join(sizes.select("pool", "blocks"), "pool")
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "pool", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "digest", "copies", "tokens")

    def count(t):
        own = [np.frombuffer(x.as_py(), np.uint64) for x in t["tokens"]]
        side = (t["own"].to_numpy() != t["i"][0].as_py()).astype(int)
        whole = t["i"][0].as_py() == t["j"][0].as_py()
        if not whole and len(np.unique(side)) < 2:
            return pa.table({"digest": pa.array([], pa.binary()), "linked": pa.array([], pa.int64())})
        found = Block(own, percent).partners(t["copies"].to_numpy(), side)
        some = np.flatnonzero(found)
        return pa.table({"digest": t["digest"].take(pa.array(some)), "linked": found[some]})

    return dealt.groupBy("pool", "i", "j").applyInArrow(count, "digest binary, linked long").groupBy("digest").agg(F.sum("linked").alias("linked"))


def links(sets: DataFrame, pools: DataFrame, sizes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between sets (digest, n, tokens) that connect every two sets which a chain of links connects."""
    members = pools.join(sets.select("digest", "n", "tokens").hint("merge"), "digest")
    blocks = F.when((F.col("digest") == F.col("hub")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")))
    dealt = members.join(sizes, "pool").select("pool", F.explode(blocks).alias("block"), "digest", "tokens")

    def link(t):
        names, own = _sets(t)
        return _edges([(names[a], names[b]) for a, b in Block(own, percent).link_all()])

    found = stored(dealt.groupBy("pool", "block").applyInArrow(link, EDGES))
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        return found
    # Pools of several blocks: the largest group is settled within itself; every other document meets all blocks.
    group = pools.join(F.broadcast(large) if large.count() <= 10_000 else large, "pool").join(
        components(found).withColumnRenamed("node", "digest"), "digest", "left")
    group = stored(group.withColumn("component", F.coalesce("component", "digest")))
    most = group.groupBy("pool", "component").count().groupBy("pool").agg(F.max(F.struct("count", "component"))["component"].alias("most"))
    outside = stored(group.join(most, "pool").where("component != most").select("pool", "digest", "blocks", "component"))
    rounds = outside.groupBy("pool").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("rounds"))
    asking = outside.join(rounds, "pool").join(sets, "digest").select(
        "pool", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("digest", F.lit(1)), F.col("rounds")).cast("int").alias("round"), "digest", "component", "tokens")
    given = group.join(rounds, "pool").join(sets, "digest").select(
        "pool", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"), "digest", "component", "tokens")

    def across(left, right):
        both = pa.concat_tables([right.select(["digest", "component", "tokens"]), left.select(["digest", "component", "tokens"])])
        names, own = _sets(both)
        if not left.num_rows or not right.num_rows:
            return _edges([])
        label = dict(zip(both["digest"].to_pylist(), both["component"].to_pylist(), strict=True))
        block, place = Block(own, percent), {d: i for i, d in enumerate(names)}
        numbers = {c: i for i, c in enumerate(dict.fromkeys(label[d] for d in names))}
        block.group = np.array([numbers[label[d]] for d in names])
        inside = np.zeros(len(names), bool)
        inside[[place[d] for d in set(right["digest"].to_pylist())]] = True
        for d in dict.fromkeys(left["digest"].to_pylist()):
            a = place[d]
            block.join(a, block.search(a, inside & (block.group != block.group[a])))
        return _edges([(names[a], names[b]) for a, b in block.edges])

    given = given.toDF(*given.columns)  # both sides hold columns of ``sets``
    keys = ("pool", "block", "round")
    return stored(found.union(asking.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(across, EDGES)))


def jaccard_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, count_links: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, tie (hash of the text), n_shingles, component_id, and
    whether the row is the one that stays for its group (smallest doc_id, then smallest tie; equal rows alike). With
    ``count_links`` also n_links, the number of other rows that the row links with, copies included.

    Null texts, and texts without words, have the empty set and are linked with nothing. Documents of equal sets
    are linked; a repeated doc_id is a document for each of its rows. Null doc_ids take part, but a group's id is
    the smallest that is not null. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    counts = stored(shared_counts(docs, width))
    nodes = counts.where(f"n > 0 AND shared * 100 >= n * {percent}").groupBy("digest").agg(
        F.min(F.struct("doc_id", "tie")).alias("r"), F.max("n").alias("n"), F.count("*").alias("copies"))
    chosen = stored(nodes.select(F.col("r.doc_id").alias("_id"), F.col("r.tie").alias("_tie"), "digest", "n", "copies"))

    def sets_of(batches):
        for digest, n, copies, text in text_batches(batches, ["digest", "n", "copies", "text"], "words"):
            yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([n]), pa.array([copies]), pa.array([shingles(text, width).tobytes()], pa.binary())],
                                             ["digest", "n", "copies", "tokens"])

    few = docs.where(maybe_in(F.xxhash64("doc_id", "tie"), chosen.select(F.xxhash64("_id", "_tie").alias("k"))))
    met = few.join(chosen.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
    sets = stored(met.select("digest", "n", "copies", "text").mapInArrow(sets_of, "digest binary, n long, copies long, tokens binary"))
    pools, sizes = pooled(sets, percent)
    groups = components(links(sets, pools, sizes, percent)).withColumnRenamed("node", "digest")
    if count_links:
        linked = chosen.select("digest", "copies").join(link_counts(sets, pools, sizes, percent), "digest", "left")
        groups = linked.select("digest", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")).join(groups, "digest", "left")
    more = {"n_links": F.coalesce("n_links", F.lit(0))} if count_links else {}
    labelled = counts.join(stored(groups), "digest", "left").withColumn("g", F.when(F.col("n") > 0, F.coalesce("component", "digest")))
    labelled = stored(labelled.select("doc_id", "tie", "n", "g", *[c.alias(n) for n, c in more.items()]))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    least = labelled.where("g IS NOT NULL").groupBy("g").agg(F.min(order).alias("least"))
    return labelled.join(least, "g", "left").select(
        "doc_id", "tie", F.col("n").alias("n_shingles"), F.coalesce("least.doc_id", "doc_id").alias("component_id"), *more,
        (F.col("least").isNull() | (F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.tie") == F.col("tie")))).alias("stays"))


def op3_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard_groups(docs, count_links=True).select("doc_id", "n_shingles", "component_id", "n_links")
