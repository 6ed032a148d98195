"""Sharding by extendible hashing: only buckets over the byte limit split on another hash bit.

Rows carry a 64-bit hash of their key. The directory is refined in steps of 16 bits: each step sums the
bytes of the (at most 65536 per parent) hash-prefix cells that still matter and finds, for every cell, the
shortest prefix whose bytes fit the limit. A prefix that fits is a shard; shorter ones were all oversized,
so exactly the oversized buckets were split. Only (hash, bytes) pairs are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from helixmart.llm.common import pick, stored, table

#: Bytes of text a shard may hold, and in the registered query, where small tables are to be split as well.
LIMIT_BYTES, QUERY_LIMIT = 16 << 20, 1 << 20
STEP = 16


def key_hash(key: Column) -> Column:
    """64 bits of md5 over the key's text, as a hex text of 16 characters; a null key counts as the empty text."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 16)


def bits(hexes: Column) -> Column:
    """Hex text -> bit text."""
    return F.lpad(F.conv(hexes, 16, 2), 64, "0")


def extendible_shards(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text",
                      keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the kept columns, ``shard`` (its hash-prefix bits), ``depth``, ``n_bytes``,
    ``shard_bytes``, ``shard_rows`` and ``oversized``.

    The key's hash decides the shard, so a key can be looked up through the directory alone. Rows of one key
    share all its bits. If they exceed the limit by themselves, bits after the 64th come from a hash of the
    row's number, so even a key with a third of all rows is split until its shards fit; such shards have depth
    over 64. A single row larger than the limit gets a shard that stays ``oversized``. Null texts have 0 bytes;
    null keys share one hash; an empty table gives no rows; equal rows are kept and counted each.
    """
    keep = keep or [key]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], key_hash(F.col(f"`{key}`")).alias("_hex"),
                       F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"))
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    # Two more words of bits for rows whose key alone is too heavy for one shard.
    rows = rows.withColumn("_bits", F.concat(bits(F.col("_hex")), bits(key_hash(F.concat_ws(":", "_hex", "_row")))))
    found, rest, parent = None, rows.select("_bits", "n_bytes"), 0
    while True:
        sums, rest = _refine(rest, parent, limit_bytes)
        found = sums if found is None else found.union(sums)
        parent += STEP
        if rest is None or parent >= 128 or rest.isEmpty():
            break
    directory = stored(found)
    return _assign(rows, directory, keep, limit_bytes)


def _refine(rest: DataFrame, parent: int, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Shards whose depth lies in (parent, parent + STEP] (or 0), and the rows of cells that need more bits."""
    last = parent + STEP >= 128
    cells = rest.groupBy(F.substring("_bits", 1, parent + STEP).alias("cell")).agg(
        F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
    cells = stored(cells)
    depths = range(0 if parent == 0 else parent + 1, parent + STEP + 1)
    # A cell counts towards each of its prefixes; sums of sums, so a prefix is a few thousand small rows at most.
    prefixes = cells.select("bytes", "n", F.explode(F.array(*[
        F.struct(F.lit(d).alias("depth"), F.substring("cell", 1, d).alias("shard")) for d in depths])).alias("p"))
    sums = prefixes.groupBy("p.depth", "p.shard").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    sums = stored(sums)
    fits = (F.col("bytes") <= limit) | (F.col("n") == 1)
    fit = sums.where(fits | (F.col("depth") == 128)) if last else sums.where(fits)
    # A prefix is a shard when it fits and the prefix one bit shorter does not (or does not exist here).
    above = sums.where(~fits).select(F.col("depth").alias("up"), F.col("shard").alias("up_shard"))
    inner = fit.join(above, (F.col("depth") - 1 == F.col("up")) & (F.substring("shard", 1, F.col("depth") - 1) == F.col("up_shard")),
                     "left_semi")
    top = fit.where(F.col("depth") == depths[0])
    shards = top.unionByName(inner.where(F.col("depth") > depths[0]))
    heavy = sums.where((F.col("depth") == parent + STEP) & ~fits).select(F.col("shard").alias("cell"))
    if last:
        return shards, None
    cell = F.substring("_bits", 1, parent + STEP)
    return shards, rest.withColumn("cell", cell).join(heavy, "cell", "left_semi").drop("cell")


def _assign(rows: DataFrame, directory: DataFrame, keep: list[str], limit: int) -> DataFrame:
    """Meet each row with its shard. A row asks for its prefix of every depth that the directory uses; shards exclude each
    other, so one answers. The depths in use are few, and the directory is never listed cell by cell."""
    depths = sorted(r[0] for r in directory.select("depth").distinct().collect())  # at most 129
    asked = rows.withColumn("_p", F.explode(F.array(*[
        F.struct(F.lit(d).alias("depth"), F.substring("_bits", 1, d).alias("shard")) for d in depths]))) if depths else rows.withColumn(
        "_p", F.struct(F.lit(0).alias("depth"), F.lit("").alias("shard")))
    met = asked.select(*rows.columns, "_p.depth", "_p.shard").join(directory, ["depth", "shard"])
    return met.select(*[F.col(f"`{c}`") for c in keep], "shard", F.col("depth").cast("int").alias("depth"), "n_bytes",
                      F.col("bytes").cast("long").alias("shard_bytes"), F.col("n").cast("long").alias("shard_rows"),
                      (F.col("bytes") > limit).alias("oversized"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return extendible_shards(pick(table(spark, folder, "documents"), "doc_id", "text"), QUERY_LIMIT)


def sharding_sql(limit_bytes: int = QUERY_LIMIT, depth: int = 16) -> str:
    """The same by DuckDB for data that needs at most ``depth`` bits."""
    return f"""
WITH rows AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8) AS hx FROM documents),
b AS (SELECT doc_id, n_bytes, lpad(bin(('0x' || hx)::BIGINT), 32, '0') AS bits FROM rows),
p AS (SELECT d AS depth, substr(bits, 1, d) AS shard, sum(n_bytes)::BIGINT AS bytes, count(*) AS n
      FROM b, range(0, {depth + 1}) t(d) GROUP BY ALL),
hit AS (SELECT b.doc_id, b.n_bytes, p.*, row_number() OVER (PARTITION BY b.doc_id ORDER BY p.depth) AS k
        FROM b JOIN p ON substr(b.bits, 1, p.depth::INT) = p.shard AND (p.bytes <= {limit_bytes} OR p.n = 1))
SELECT doc_id, shard, depth::INT AS depth, n_bytes, bytes AS shard_bytes, n AS shard_rows, bytes > {limit_bytes} AS oversized
FROM hit WHERE k = 1"""
