"""Expression statistics, label rules, thresholds, splits and classification counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from helixmart.functions import constants as C, markers as M
from helixmart.functions.rules import flag
from helixmart.operators.ranking import group_quantiles, hashed_rank

# -- expression matrix in long form: gene_symbol, sample_id, value -----------------------------


def as_matrix(expression: DataFrame) -> DataFrame:
    """One value per gene and sample."""
    return expression.groupBy("gene_symbol", "sample_id").agg(F.max("expression_value").alias("value"))


#: Tumour columns of the reference study, which has 86 columns.
STUDY_TUMOURS = 79


def sample_groups(matrix: DataFrame, position: Column, tumours: int | None = None) -> DataFrame:
    """Tumour or normal by column position: the first ``tumours`` columns are tumours.

    Without a number the reference rule holds, which fits its own study only: STUDY_TUMOURS of at least 80 columns,
    else the first 90 %.
    """
    if tumours is None:
        total = matrix.agg(F.countDistinct("sample_id")).scalar()
        limit = F.when(total > STUDY_TUMOURS, F.lit(STUDY_TUMOURS)).otherwise(F.floor(total * 0.9))
    else:
        limit = F.lit(tumours)
    return matrix.withColumn("sample_group", F.when(position < limit, "tumor").otherwise("normal"))


def matrix_quality(matrix: DataFrame) -> DataFrame:
    """Size, missing cells, completeness, range and the range of sample and gene means."""
    means = {k: matrix.groupBy(k).agg(F.avg("value").alias("m")) for k in ("sample_id", "gene_symbol")}

    def ends(key: str) -> Column:
        return means[key].agg(F.struct(F.min("m").alias("low"), F.max("m").alias("high"), F.avg("m").alias("mid"))).scalar()

    base = matrix.agg(
        F.countDistinct("gene_symbol").alias("n_genes"), F.countDistinct("sample_id").alias("n_samples"),
        F.count("value").alias("n_present"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    size = F.col("n_genes") * F.col("n_samples")
    return base.withColumns({"_s": ends("sample_id"), "_g": ends("gene_symbol")}).select(
        "n_genes", "n_samples", size.alias("n_cells"), (size - F.col("n_present")).alias("missing_cells"),
        (F.col("n_present") * 100.0 / size).alias("completeness"), "min_value", "max_value",
        F.col("_s.mid").alias("mean_of_sample_means"), F.col("_s.low").alias("min_sample_mean"),
        F.col("_s.high").alias("max_sample_mean"), F.col("_g.low").alias("min_gene_mean"),
        F.col("_g.high").alias("max_gene_mean"))


def gene_variance(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("gene_symbol").agg(F.var_samp("value").alias("variance"))


def top_variable_genes(matrix: DataFrame, n: int = 20) -> DataFrame:
    return gene_variance(matrix).orderBy(F.desc_nulls_last("variance"), "gene_symbol").limit(n)


def fold_changes(grouped: DataFrame) -> DataFrame:
    """Tumour minus normal mean per gene (values are log2), with both direction rules."""

    def mean_of(group: str) -> Column:
        return F.avg(F.when(F.col("sample_group") == group, F.col("value")))

    change = F.col("fold_change")
    return (
        grouped.groupBy("gene_symbol").agg(mean_of("tumor").alias("tumor_mean"), mean_of("normal").alias("normal_mean"))
        .withColumn("fold_change", F.col("tumor_mean") - F.col("normal_mean"))
        .withColumn("regulated", F.when(change > 1, "UP").when(change < -1, "DOWN"))
        .withColumn("direction", F.when(change > 0.5, "UP").when(change < -0.5, "DOWN").otherwise("SIMILAR"))
    )


def extreme_changes(changes: DataFrame, n: int = 5, cut: float = 1.0) -> DataFrame:
    """Largest rises above ``cut`` and largest falls below minus ``cut``."""
    change = F.col("fold_change")
    up = changes.where(change > cut).orderBy(F.desc("fold_change"), "gene_symbol").limit(n)
    down = changes.where(change < -cut).orderBy("fold_change", "gene_symbol").limit(n)
    return up.withColumn("regulated", F.lit("UP")).unionByName(down.withColumn("regulated", F.lit("DOWN")))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; the range is a one-row subquery."""
    value = F.col(column).cast("double")
    ends = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    ranged = df.where(value.isNotNull()).select(value.alias("_v"), ends.alias("_e"))
    flat = F.col("_e.low") == F.col("_e.high")
    low = F.when(flat, F.col("_e.low") - 0.5).otherwise(F.col("_e.low"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("_e.high") - F.col("_e.low")) / bins
    at = F.least(F.floor((F.col("_v") - low) / width), F.lit(bins - 1)).cast("int")
    return ranged.groupBy(at.alias("bin"), low.alias("_low"), width.alias("_w")).agg(F.count("*").alias("n")).select(
        "bin", (F.col("_low") + F.col("bin") * F.col("_w")).alias("lower_edge"), "n")


# -- subtype labels ----------------------------------------------------------------------------

MARKERS = [g.lower() for g in C.MATRIX_MARKERS]


def marker_matrix(core: DataFrame) -> DataFrame:
    """Samples by the four markers, missing ones as 0."""
    return core.select("sample_id", *[F.coalesce(f"{g}_expr", F.lit(0.0)).alias(g) for g in MARKERS])


def z_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds z_<column>; mean and deviation (n - 1) come from one one-row subquery."""
    moments = []
    for name in columns:
        moments += [F.avg(name).alias(f"m_{name}"), F.stddev_samp(name).alias(f"s_{name}")]
    one = df.agg(F.struct(*moments)).scalar()
    wide = df.withColumn("_m", one)

    def z(name: str) -> Column:
        spread = F.col(f"_m.s_{name}")
        return (F.col(name) - F.col(f"_m.m_{name}")) / F.when(spread == 0, F.lit(1e-6)).otherwise(spread)

    return wide.withColumns({f"z_{n}": z(n) for n in columns}).drop("_m")


def max_label(df: DataFrame) -> Column:
    return M.max_marker_label({g.upper(): F.col(g) for g in MARKERS})


def z_rule_label(extra_ne: Sequence[str] = ()) -> Column:
    """Subtype from z-scores: P, N, A by a high z and a raw margin, then Y by a low NE sum, then the top z."""
    high, mid, margin = 1.0, 0.5, 0.35
    raw = {g: F.col(g) for g in MARKERS}
    z = {g: F.col(f"z_{g}") for g in MARKERS}

    def leads(gene: str) -> Column:
        return raw[gene] >= F.greatest(*[c for g, c in raw.items() if g != gene]) + margin

    ne_sum = z["ascl1"] + z["neurod1"]
    for name in extra_ne:
        ne_sum = ne_sum + F.col(f"z_{name}")
    top = F.greatest(*z.values())
    out = (
        F.when((z["pou2f3"] > high) & leads("pou2f3"), "SCLC-P")
        .when((z["neurod1"] > high) & (z["ascl1"] <= mid) & leads("neurod1"), "SCLC-N")
        .when((z["ascl1"] > high) & (z["neurod1"] <= mid) & leads("ascl1"), "SCLC-A")
        .when((ne_sum < 0) & (z["yap1"] > 0.3), "SCLC-Y"))
    for gene in MARKERS:
        out = out.when(z[gene] == top, C.MARKER_SUBTYPE[gene.upper()])
    return out.otherwise("Unclassified")


def labelled(core: DataFrame) -> DataFrame:
    """Markers with both labels per sample."""
    return z_scores(marker_matrix(core), MARKERS).select(
        "*", max_label(core).alias("max_label"), z_rule_label().alias("z_label"))


def means_by_label(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Mean per subtype; every subtype appears, in its fixed place."""
    order = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(C.SUBTYPES)], f"place int, {label} string")
    means = df.groupBy(label).agg(*[F.avg(c).alias(c) for c in columns])
    return order.join(means, label, "left")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """mean, std, min, max per column: one pass, then columns to rows."""
    one = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
                   .alias(c) for c in columns])
    return one.unpivot([], list(columns), "marker", "s").select("marker", "s.*")


def label_comparison(df: DataFrame, first: str, second: str) -> DataFrame:
    left = df.groupBy(F.col(first).alias("label")).agg(F.count("*").alias("n_first"))
    right = df.groupBy(F.col(second).alias("label")).agg(F.count("*").alias("n_second"))
    return left.join(right, "label", "full").fillna(0, ["n_first", "n_second"])


def proportions(df: DataFrame, label: str, z: float = 1.96) -> DataFrame:
    """Share of every subtype with the Wilson 95 % interval."""
    order = df.sparkSession.createDataFrame([(s,) for s in C.SUBTYPES], "subtype string")
    counted = df.where(F.col(label).isin(C.SUBTYPES)).groupBy(F.col(label).alias("subtype")).agg(F.count("*").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).scalar()
    p, size = F.col("p"), F.col("total")
    centre = p + z * z / (2 * size)
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * size)) / size)
    bottom = 1 + z * z / size
    return (
        order.join(counted, "subtype", "left").fillna(0, ["n"]).withColumn("total", F.nullif(total, F.lit(0.0)))
        .withColumn("p", F.coalesce(F.col("n") / size, F.lit(0.0)))
        .select("subtype", "n", F.round("p", 3).alias("proportion"),
                F.coalesce(F.round(F.greatest((centre - margin) / bottom, F.lit(0.0)), 3), F.lit(0.0)).alias("ci_low"),
                F.coalesce(F.round(F.least((centre + margin) / bottom, F.lit(1.0)), 3), F.lit(0.0)).alias("ci_high"),
                F.round(p * 100, 1).alias("percent"))
    )


def _f_tail(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """P(F > f) by the continued fraction of the incomplete beta function."""
    from math import lgamma

    log_gamma = np.vectorize(lgamma)

    def fraction(a, b, x):
        tiny = 1e-300
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d
        for m in range(1, 300):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                         -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + step * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + step / np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        return h

    a, b, x = d2 / 2, d1 / 2, d2 / (d2 + d1 * f)
    flip = x >= (a + 1) / (a + b + 2)
    a1, b1, x1 = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore"):
        front = np.exp(log_gamma(a1 + b1) - log_gamma(a1) - log_gamma(b1) + a1 * np.log(x1) + b1 * np.log1p(-x1))
    tail = np.where(x1 <= 0, 0.0, front * fraction(a1, b1, x1) / a1)
    return np.clip(np.where(flip, 1 - tail, tail), 0, 1)


def anova(df: DataFrame, label: str, columns: Sequence[str], min_group: int = 3) -> DataFrame:
    """One-way ANOVA per column over the subtypes with at least three values.

    F comes from group sums; only the small (column, F) table meets Python, for the tail.
    """
    long = df.where(F.col(label).isin(C.SUBTYPES)).unpivot([label], list(columns), "gene", "value").where(F.col("value").isNotNull())
    groups = long.groupBy("gene", label).agg(
        F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).where(F.col("n") >= min_group)
    sums = groups.groupBy("gene").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("sq") - F.col("s") * F.col("s") / F.col("n")
    tested = sums.where("k >= 2 AND n > k").select(
        "gene", (F.col("k") - 1).cast("double").alias("df1"), (F.col("n") - F.col("k")).cast("double").alias("df2"),
        ((between / (F.col("k") - 1)) / F.nullif(F.col("within") / (F.col("n") - F.col("k")), F.lit(0.0))).alias("f_value"))

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = _f_tail(pdf["f_value"].to_numpy(float), pdf["df1"].to_numpy(float), pdf["df2"].to_numpy(float))
            yield pdf.assign(p_value=p)

    p = F.col("p_value")
    return tested.mapInPandas(tails, "gene string, df1 double, df2 double, f_value double, p_value double").withColumn(
        "stars", F.when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 5e-2, "*").otherwise("ns"))


# -- risk targets, splits, weights -------------------------------------------------------------


def risk_thresholds(clinical: DataFrame) -> DataFrame:
    """One row: median and third quartile of burden and mutation count."""
    tmb = group_quantiles(clinical, [], "tmb", {"tmb_median": 0.5, "tmb_q75": 0.75})
    mutations = group_quantiles(clinical, [], "mutation_count", {"mutation_median": 0.5, "mutation_q75": 0.75})
    return tmb.select("*", mutations.select(F.struct("mutation_median", "mutation_q75")).scalar().alias("m")).select(
        "tmb_median", "tmb_q75", "m.*")


def risk_targets(clinical: DataFrame) -> DataFrame:
    """Adds biological_high_risk, survival_high_risk and the hybrid binary_risk."""
    cuts = risk_thresholds(clinical).select(F.struct("*")).scalar()
    short = F.col("target_category") == "SHORT"
    return clinical.withColumn("_t", cuts).withColumns({
        "biological_high_risk": flag(
            (F.col("tmb") > F.col("_t.tmb_median")) | (F.col("mutation_count") > F.col("_t.mutation_median"))
            | (F.col("is_advanced_stage") == 1)),
        "survival_high_risk": flag(short),
        "binary_risk": flag(
            (F.col("tmb") > F.col("_t.tmb_q75")) | (F.col("mutation_count") > F.col("_t.mutation_q75"))
            | (short & (F.col("tmb") > F.col("_t.tmb_median")))),
    }).drop("_t")


def target_means(targets: DataFrame) -> DataFrame:
    """Means per class, and whether the high class has the higher burden and mutation count."""
    means = targets.groupBy("binary_risk").agg(
        F.count("*").alias("n"), F.avg("age").alias("mean_age"), F.avg("tmb").alias("mean_tmb"),
        F.avg("mutation_count").alias("mean_mutations"), F.avg("target_survival_months").alias("mean_survival"))
    high = means.where("binary_risk = 1").select(F.struct("mean_tmb", "mean_mutations")).scalar()
    low = means.where("binary_risk = 0").select(F.struct("mean_tmb", "mean_mutations")).scalar()
    return means.withColumns({"_h": high, "_l": low}).withColumns({
        "tmb_direction_ok": F.col("_h.mean_tmb") > F.col("_l.mean_tmb"),
        "mutation_direction_ok": F.col("_h.mean_mutations") > F.col("_l.mean_mutations")}).drop("_h", "_l")


def stratified_split(df: DataFrame, label: str, identity: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds split = test/train with the exact share per class, in hash order."""
    ranked = hashed_rank(df, label, F.concat(F.col(identity), F.lit(f":{seed}")))
    size = F.round(F.col("group_size") * F.lit(test_share))
    return ranked.withColumn("split", F.when(F.col("hash_rank") <= size, "test").otherwise("train")).drop("hash_rank", "group_size")


def stratified_folds(df: DataFrame, label: str, identity: str, folds: int = 5, seed: int = 42) -> DataFrame:
    ranked = hashed_rank(df, label, F.concat(F.col(identity), F.lit(f":fold:{seed}")))
    return ranked.withColumn("fold", F.pmod(F.col("hash_rank") - 1, F.lit(folds)).cast("int")).drop("hash_rank", "group_size")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * n of the class), one row per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.withColumn("_w", whole).select(
        label, (F.col("_w.n").cast("double") / (F.col("_w.k") * F.col("n"))).alias("class_weight"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from the confusion counts."""
    both = matrix.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"),
                 F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("hit"),
                 F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed")))).alias("r")).select("r.*")
    sums = both.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("hit", "support", "claimed")])
    hit = F.col("hit").cast("double")

    def ratio(part, whole):
        return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))

    return sums.select("label", ratio(hit, F.col("claimed")).alias("precision"), ratio(hit, F.col("support")).alias("recall"),
                       ratio(2 * hit, F.col("claimed") + F.col("support")).alias("f1"), "support")


def scored_summary(scored: DataFrame) -> DataFrame:
    """Counts and shares of levels that contain HIGH, MODERATE or LOW, and the mean score."""
    n = F.count("*").cast("double")
    parts = []
    for word in ("HIGH", "MODERATE", "LOW"):
        hits = F.count_if(F.col("risk_level").contains(word))
        parts += [hits.alias(f"n_{word.lower()}"), F.round(hits * 100.0 / n, 0).alias(f"pct_{word.lower()}")]
    return scored.agg(F.count("*").alias("n"), *parts, F.avg("risk_score").alias("avg_score"))
