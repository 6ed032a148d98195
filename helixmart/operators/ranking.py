"""Exact quantiles and ranks that never gather one group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_STEPS_PER_OCTAVE = 64
_SHIFT = 1 << 20
#: Parts that a wanted bucket is cut into. A bucket spans 1/64 of a power of two, that is about 2**46 doubles, so no
#: part can hold more than about 2**26 different values, however close together the data lie.
_PARTS = 1 << 20


def _octave(value: Column) -> Column:
    """Order-preserving bucket of a double: 64 per power of two, at most ~270k in all."""
    size = F.floor(F.log2(F.abs(value)) * _STEPS_PER_OCTAVE) + F.lit(_SHIFT)
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("bigint")


def _part(value: Column, low: Column, high: Column) -> Column:
    """Order-preserving part of a bucket whose values run from ``low`` to ``high``: each step rounds monotonically."""
    return F.when(high > low, F.floor((value - low) / (high - low) * float(_PARTS))).otherwise(F.lit(0)).cast("bigint")


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of the finite ``value``s per group, exact for groups of any size.

    Radix selection: equal values are counted before the shuffle, a histogram over value buckets finds the buckets that
    hold the wanted ranks, those are cut into a million parts between their least and largest value, and only the parts
    that hold the ranks are sorted. So neither a hot group nor values that nearly agree fill one task.
    """
    keys = list(keys)
    anchor = keys or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    counted = (
        src.where(F.abs(F.col(value).cast("double")) < float("inf"))  # not NULL, NaN or infinite
        .groupBy(*anchor, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_b", _octave(F.col("_v")))
    )

    def position(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(float(p))

    ranks = {name: (F.floor(position(p)), F.ceil(position(p))) for name, p in probs.items()}

    def holds(rank: Column, first: Column, end: Column) -> Column:
        return (rank >= first) & (rank < end)

    def wanted(first: Column, end: Column) -> Column:
        hit = F.lit(False)
        for low, high in ranks.values():
            hit = hit | holds(low, first, end) | holds(high, first, end)
        return hit

    def upto(n: str, within: list[str], order: str) -> Column:
        return F.sum(n).over(W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, 0))

    buckets = (
        counted.groupBy(*anchor, "_b").agg(F.sum("_n").alias("_bn"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        .withColumn("_end", upto("_bn", anchor, "_b"))
        .withColumn("_total", F.sum("_bn").over(W.partitionBy(*anchor)))
        .withColumn("_before", F.col("_end") - F.col("_bn"))
        .where(wanted(F.col("_before"), F.col("_end"))).drop("_bn", "_end")
    )
    inside = counted.join(buckets, [*anchor, "_b"]).withColumn("_s", _part(F.col("_v"), F.col("_low"), F.col("_high")))
    parts = (
        inside.groupBy(*anchor, "_b", "_s", "_total", "_before").agg(F.sum("_n").alias("_bn"))
        .withColumn("_end", F.col("_before") + upto("_bn", [*anchor, "_b"], "_s"))
        .withColumn("_start", F.col("_end") - F.col("_bn"))
        .where(wanted(F.col("_start"), F.col("_end"))).select(*anchor, "_b", "_s", "_start")
    )
    picked = (
        inside.join(parts, [*anchor, "_b", "_s"])
        .withColumn("_end", F.col("_start") + upto("_n", [*anchor, "_b", "_s"], "_v"))
        .withColumn("_first", F.col("_end") - F.col("_n"))
    )
    aggs = []
    for name, p in probs.items():
        low, high = ranks[name]
        at_low = F.max(F.when(holds(low, F.col("_first"), F.col("_end")), F.col("_v")))
        at_high = F.max(F.when(holds(high, F.col("_first"), F.col("_end")), F.col("_v")))
        part = F.max(position(p) - low)
        aggs.append((at_low + (at_high - at_low) * part).alias(name))
    out = picked.groupBy(*anchor).agg(*aggs)
    return out if keys else out.drop("_all")


#: Rows of a group that one task may gather: 800 kB of doubles.
GATHERED = 100_000


def by_group_size(df: DataFrame, keys: Sequence[str], gathered: int = GATHERED) -> tuple[DataFrame, DataFrame]:
    """Rows of groups that one task may gather, and rows of larger groups."""
    keys = list(keys)
    # As many rows as there are groups of more than ``gathered`` rows.
    large = F.broadcast(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > gathered).select(*keys))
    return df.join(large, keys, "left_anti"), df.join(large, keys, "left_semi")


def quantile_of_sorted(values: Column, p: float) -> Column:
    """Linear-interpolated quantile of a sorted array; NULL for an empty one."""
    at = (F.size(values) - 1) * F.lit(float(p))
    low, high = (F.element_at(values, place.cast("int") + 1) for place in (F.floor(at), F.ceil(at)))
    return F.when(F.size(values) > 0, low + (high - low) * (at - F.floor(at)))


def quantiles_of_many_groups(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                             gathered: int = GATHERED) -> DataFrame:
    """``group_quantiles`` where most groups are small: those of at most ``gathered`` rows are sorted as a whole, after one
    shuffle; larger ones take the radix selection. Same results."""
    keys = list(keys)
    rows = df.where(F.abs(F.col(value).cast("double")) < float("inf")).dropna(subset=keys).select(
        *keys, F.col(value).cast("double").alias("_v"))
    small, large = by_group_size(rows, keys, gathered)
    small = small.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    return small.select(*keys, *[quantile_of_sorted(F.col("_s"), p).alias(name) for name, p in probs.items()]).unionByName(
        group_quantiles(large, keys, "_v", probs))


def hashed_rank(df: DataFrame, group: str, identity: Column, rank_name: str = "hash_rank") -> DataFrame:
    """1-based position of every row inside ``group`` in the order of md5(identity).

    The hash splits each group into 65536 even buckets, so ranks come from bucket
    offsets plus a rank inside one small bucket; no task sorts a whole group.
    """
    hashed = df.withColumn("_h", F.md5(identity.cast("binary"))).withColumn(
        "_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")
    )
    offsets = (
        hashed.groupBy(group, "_b").agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(
            W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("group_size", F.sum("_n").over(W.partitionBy(group)))
        .select(group, "_b", (F.col("_upto") - F.col("_n")).alias("_before"), "group_size")
    )
    inside = F.row_number().over(W.partitionBy(group, "_b").orderBy("_h"))
    return (
        hashed.withColumn("_r", inside)
        .join(offsets, [group, "_b"])
        .withColumn(rank_name, (F.col("_before") + F.col("_r")).cast("bigint"))
        .drop("_h", "_b", "_before", "_r")
    )


def running_total(df: DataFrame, key: str, order: str, value: str, name: str, block: int = 1000) -> DataFrame:
    """Adds the sum of ``value`` over the rows before this one in its group.

    ``order`` is a whole number, unique per group. Sums run inside blocks of it and over
    the block totals, so no task holds a group.
    """
    blocks = df.withColumn("_k", F.floor(F.col(order) / float(block)))
    inside = W.partitionBy(key, "_k").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(key).orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    totals = blocks.groupBy(key, "_k").agg(F.sum(value).alias("_t")).select(
        key, "_k", F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_base"))
    return (
        blocks.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(totals, [key, "_k"])
        .withColumn(name, F.col("_base") + F.col("_in"))
        .drop("_k", "_in", "_base")
    )
