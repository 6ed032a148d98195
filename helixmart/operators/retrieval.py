"""Retrieval over vectors: hits, tiers, confidence, routing and source context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixmart.functions import constants as C
from helixmart.functions.rules import band
from helixmart.operators.probes import vector_best, vector_top_k


def parsed_vectors(staged: DataFrame, text: str, size: int) -> DataFrame:
    """JSON text to a typed vector; ``is_valid`` marks the expected length."""
    vector = F.from_json(F.col(text), "array<double>")
    return staged.withColumn("embedding", vector).withColumn(
        "is_valid", F.coalesce((F.size("embedding") == size) & ~F.exists("embedding", lambda x: x.isNull()), F.lit(False)))


def search_text(chunks: DataFrame, questions: DataFrame, k: int = C.TOP_HITS) -> DataFrame:
    hits = vector_top_k(chunks, questions, "id", "query_id", k=k, min_score=C.TEXT_MIN_SCORE)
    return hits.withColumn("tier", band(F.col("score"), C.TEXT_TIERS))


def search_images(images: DataFrame, questions: DataFrame, k: int = C.TOP_HITS) -> DataFrame:
    hits = vector_top_k(images, questions, "id", "query_id", k=k, min_score=C.IMAGE_MIN_SCORE)
    return hits.withColumn("tier", band(F.col("score"), C.IMAGE_TIERS))


def all_hits(text_hits: DataFrame, image_hits: DataFrame) -> DataFrame:
    return text_hits.withColumn("kind", F.lit("text")).unionByName(image_hits.withColumn("kind", F.lit("image")))


def confidence(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Plain mean of all kept scores per question, 0 without a hit, with source counts."""
    scored = hits.groupBy("query_id").agg(
        F.avg("score").alias("c"), F.count_if(F.col("kind") == "text").alias("t"),
        F.count_if(F.col("kind") == "image").alias("i"))
    return questions.select("query_id").join(scored, "query_id", "left").select(
        "query_id", F.coalesce("c", F.lit(0.0)).alias("confidence"),
        F.coalesce("t", F.lit(0)).cast("bigint").alias("n_text"),
        F.coalesce("i", F.lit(0)).cast("bigint").alias("n_images"),
        (F.coalesce("t", F.lit(0)) + F.coalesce("i", F.lit(0)) > 0).alias("has_sources"))


def route(confidence_col: Column, papers: Column, web: Column) -> list[Column]:
    """Answer route and combined confidence from own confidence and the outside finds.

    Above 0.6 own sources do; below 0.5 outside pair; between, papers are added and
    the raised confidence decides. The web-only arm needs a raised value below 0.5,
    which a confidence of at least 0.5 cannot give; it is kept for completeness.
    """
    c = confidence_col
    outside = F.least(
        c + F.when(papers >= 2, 0.15).otherwise(0.1) + F.when(web >= 3, 0.15).otherwise(0.1), F.lit(0.95))
    raised = F.least(c + F.when(papers >= 2, 0.1).otherwise(0.05), F.lit(1.0))
    web_only = F.least(c + F.when(web >= 3, 0.2).otherwise(0.15), F.lit(0.7))
    name = (
        F.when(c > 0.6, "RAG").when(c < 0.5, "Arxiv + Web").when(raised > 0.6, "RAG + Arxiv")
        .when(raised < 0.5, "Web").otherwise("RAG + Arxiv + Web"))
    value = F.when(c > 0.6, c).when(c < 0.5, outside).when(raised > 0.6, raised).when(raised < 0.5, web_only).otherwise(raised)
    return [name.alias("agent_used"), value.alias("combined_confidence")]


_BLOCKS = [("HIGH", "text"), ("HIGH", "image"), ("MEDIUM", "text"), ("MEDIUM", "image"), ("LOW", "text"), ("LOW", "image")]


def source_context(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """One text per question: hits by tier, text before images, best first (at most ten hits each).

    ``sources`` has kind, id and source_text.
    """
    rank = F
    for place, (tier, kind) in enumerate(_BLOCKS):
        rank = rank.when((F.col("tier") == tier) & (F.col("kind") == kind), F.lit(place))
    lines = hits.join(sources, ["kind", "id"]).withColumn("_b", rank)
    entry = F.concat(F.col("tier"), F.lit(" "), F.col("kind"), F.lit(": "), F.col("source_text"))
    ordered = F.sort_array(F.collect_list(F.struct("_b", "place", entry.alias("line"))))
    return lines.groupBy("query_id").agg(ordered.alias("l")).select(
        "query_id", F.size("l").cast("bigint").alias("n_sources"), F.array_join(F.col("l.line"), "\n").alias("context"))


def golden_matches(questions: DataFrame, golden: DataFrame) -> DataFrame:
    """Closest golden question, accepted only above 0.85.

    The golden set is the shared side; questions are scanned where they lie.
    """
    known = golden.withColumnRenamed("question_embedding", "embedding")
    best = vector_best(questions, known, "query_id", "golden_id", min_score=C.GOLDEN_MIN_SCORE)
    return best.join(golden.drop("question_embedding"), "golden_id")


def closest_table(questions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Router fallback: the catalogued table of highest cosine."""
    return vector_best(questions, catalogue, "query_id", "table_name")
