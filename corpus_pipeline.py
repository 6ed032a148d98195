"""Corpus pipeline: toxic documents go, one document of each group of near copies stays, documents that hold a
benchmark item go, secrets are blotted out, and what is left is packed into training sequences.

Every stage takes (spark, docs, sf_dir), works on all rows it is given, and but for the last returns rows with
the columns of documents. ``run`` applies them in order; each stage's rows are stored in the shared folder, so
that a stage is computed once and survives lost executors.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixmart.llm import toxicity
from helixmart.llm.common import maybe_in, stored, table
from helixmart.llm.decontaminate import contaminated
from helixmart.llm.jaccard import jaccard_groups
from helixmart.llm.packing import TOKENIZER, pack
from helixmart.llm.secrets import redacted, scan

#: Words a generation that a packing worker remembers: its executor has grown in the stages before.
PACKING_WORDS = 100_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of the (doc_id, tie) in ``gone``; tie is the hash of a row's text."""
    gone = stored(gone.select(F.col("doc_id").cast("long").alias("__id"), F.col("tie").alias("__tie")).distinct())
    marked = docs.withColumn("__k", F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
    marked = marked.withColumn("__maybe", maybe_in(F.col("__k"), gone.select(F.xxhash64("__id", "__tie").alias("k"))))
    some = marked.where("__maybe").join(gone.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (
        F.xxhash64("text") == F.col("__tie")), "left_anti")
    return marked.where("NOT __maybe").unionByName(some).drop("__k", "__maybe")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold. The machine learns from the labelled rows outside the held-out third."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.fold(F.col("doc_id")))
    machine = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, machine, name="__score").where(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, the one of smallest doc_id; documents without words all stay."""
    groups = stored(jaccard_groups(docs.select("doc_id", "text")))
    left = _without(docs, groups.where("NOT stays"))
    again = stored(groups.where("stays AND n_shingles > 0").groupBy("doc_id", "tie").count().where("count > 1").select("doc_id", "tie"))
    if again.isEmpty():
        return left
    # Equal rows, id and text, that would all stay for their group: one of them does.
    rows = left.join(again.toDF("__id", "__tie"), left["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (
        F.xxhash64(left["text"]) == F.col("__tie"))).dropDuplicates(["__id", "__tie"]).drop("__id", "__tie")
    return _without(left, again).unionByName(rows)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    benchmark = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return _without(docs, contaminated(docs.select("doc_id", "text"), benchmark))


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; in their texts a mark stands for every secret, and n_chars counts the new text."""
    found = scan(docs, docs.columns, out="__spans")
    text = F.when(F.size("__spans") > 0, redacted(F.col("text"), F.col("__spans"))).otherwise(F.col("text"))
    n_chars = F.when(F.size("__spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select(*[text.alias("text") if c == "text" else n_chars.alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens with the mixture of all sources."""
    return pack(docs.select("doc_id", "source", "text"), public_tokenizers.path(TOKENIZER), words=PACKING_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", blot_secrets),
    ("packing", pack_sequences),
]

#: The stages cannot be expressed in SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
