"""Answer evaluation: reply parsing, scores, log updates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixmart.functions import constants as C

METRICS = ["faithfulness_score", "relevancy_score", "context_quality_score", "correctness_score"]


def judge_score(reply: Column) -> Column:
    """First number in a judge's reply, 0.0 when there is none ("10" reads as 1)."""
    number = F.regexp_extract(F.trim(reply), f"({C.JUDGE_PATTERN})", 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def scored_replies(replies: DataFrame) -> DataFrame:
    """Metric columns and their mean; correctness counts only where a golden answer was found."""
    has_truth = F.col("correctness_reply").isNotNull()
    metrics = replies.select(
        "log_id",
        judge_score(F.col("faithfulness_reply")).alias("faithfulness_score"),
        judge_score(F.col("relevancy_reply")).alias("relevancy_score"),
        judge_score(F.col("context_reply")).alias("context_quality_score"),
        F.when(has_truth, judge_score(F.col("correctness_reply"))).alias("correctness_score"))
    present = F.filter(F.array(*METRICS), lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)
    return metrics.withColumn(
        "overall_score", F.when(F.size(present) > 0, total / F.size(present)).otherwise(F.lit(0.0)))


def apply_scores(logs: DataFrame, scored: DataFrame) -> DataFrame:
    """The log with pending rows filled from the replies; rows already scored stay as they are."""
    names = [*METRICS, "overall_score"]
    fresh = scored.select("log_id", *[F.col(n).alias(f"_{n}") for n in names])
    pending = F.col("overall_score").isNull()
    out = logs.join(fresh, "log_id", "left")
    updates = {n: F.when(pending, F.col(f"_{n}")).otherwise(F.col(n)) for n in names}
    return out.select(*[updates[c].alias(c) if c in updates else F.col(c) for c in logs.columns])


def new_log_rows(interactions: DataFrame) -> DataFrame:
    """Log rows as written at answer time: scores still NULL."""
    return interactions.select("*", *[F.lit(None).cast("double").alias(n) for n in [*METRICS, "overall_score"]])


def latest_logs(logs: DataFrame, n: int = 50) -> DataFrame:
    return logs.orderBy(F.desc_nulls_last("logged_at"), "log_id").limit(n)


def pending_logs(logs: DataFrame, n: int = 5) -> DataFrame:
    return logs.where(F.col("overall_score").isNull()).orderBy("logged_at", "log_id").limit(n)


def recent_results(results: DataFrame, n: int = 10) -> DataFrame:
    """Most recent results, tagged risk or subtype by the field they carry."""
    kind = F.when(F.col("risk_level").isNotNull(), "risk").otherwise("subtype")
    return results.orderBy(F.desc_nulls_last("stored_at"), F.desc("result_id")).limit(n).select(
        "result_id", "stored_at", kind.alias("result_type"))


def logged_contexts(texts: Column, papers_summary: Column, web_summary: Column) -> Column:
    """First three chunk texts, then the outside summaries cut at 500 characters where present."""
    extra = F.filter(
        F.array(F.substring(papers_summary, 1, 500), F.substring(web_summary, 1, 500)), lambda x: x.isNotNull())
    return F.concat(F.slice(texts, 1, 3), extra)


def interaction_stats(interactions: DataFrame) -> DataFrame:
    """Response time in whole milliseconds and whether the answer had sources."""
    micros = F.unix_micros(F.col("answered_at").cast("timestamp")) - F.unix_micros(F.col("asked_at").cast("timestamp"))
    return interactions.withColumn("response_ms", F.floor(micros / 1000.0).cast("bigint")).withColumn(
        "has_sources", F.col("n_text") + F.col("n_images") > 0)


# -- chat notes ------------------------------------------------------------------------------

def note_parts(turns: DataFrame, per_part: int = 100) -> DataFrame:
    """Chat history as JSON text in parts of at most ``per_part`` turns, so no chat has to fit one value."""
    numbered = turns.withColumn("part", F.floor(F.col("turn") / float(per_part)).cast("int"))
    history = F.to_json(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "role", "content"))),
        lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))))
    return numbered.groupBy("conv_id", "part").agg(
        history.alias("chat_history"), F.count_if(F.col("role") == "user").alias("user_turns"))


def note_turns(parts: DataFrame) -> DataFrame:
    """Stored parts back to one row per message, in order."""
    messages = F.from_json("chat_history", "array<struct<role:string,content:string>>")
    return parts.select("conv_id", "part", F.posexplode(messages).alias("turn_in_part", "m")).select(
        "conv_id", "part", "turn_in_part", "m.role", "m.content")


def user_turns(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("total_queries"))


def notes_of(notes: DataFrame, user_id: int) -> DataFrame:
    """A user's notes, newest first."""
    return notes.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "note_id")
