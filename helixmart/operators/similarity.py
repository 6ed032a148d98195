"""Similar patients and profiles for a whole batch of patients at once.

Patients of equal values form one cell of a k-d tree (operators/profiles.py). Counts take whole nodes of the tree,
nearest patients come from the leaves that a distance reaches, so cells are met where they are dense and never in pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from helixmart.functions import constants as C, markers as M
from helixmart.operators import lookups
from helixmart.operators.probes import nearest_rows, range_counts
from helixmart.operators.profiles import WithinRanges, counts_of_all, nearest_of_all
from helixmart.session import cut_lineage

AGE_WIDTH, TMB_WIDTH, MUTATION_WIDTH = 10, 5, 100


def _met(rows: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """Rows meet what was found for their point; no id is multiplied by repeated ids."""
    return rows.join(found, [rows[c].cast("double") == found[c] for c in columns]).drop(*[found[c] for c in columns])


def with_similar_count(queries: DataFrame, patients: DataFrame) -> DataFrame:
    """The query rows, each with the number of patients within ten years and five mutations/Mb; none where age or burden
    is unknown."""
    reach = {"age": AGE_WIDTH, "tmb": TMB_WIDTH}
    counts = counts_of_all(queries, patients, reach)
    met = queries.join(counts, [queries[c].cast("double") == counts[c] for c in reach], "left")
    return met.select(*[queries[c] for c in queries.columns], F.coalesce("n", F.lit(0)).cast("bigint").alias("similar_patients_found"))


def count_similar(queries: DataFrame, patients: DataFrame) -> DataFrame:
    """Patients within ten years and five mutations/Mb of each query patient."""
    return with_similar_count(queries.select("sample_id", "age", "tmb"), patients).select("sample_id", "similar_patients_found")


def _nearest(queries: DataFrame, patients: DataFrame, reach: dict[str, float], counted: list[str], k: int, carry: list[str]) -> DataFrame:
    names = list(reach)
    own = {c: f"_of_{c}" for c in ["age", "tmb", *carry]}
    rows = patients.select("sample_id", *names, *[F.col(c).alias(n) for c, n in own.items()])
    metric = WithinRanges(list(reach.values()), [n in counted for n in names])
    found = nearest_of_all(queries, rows, names, "sample_id", k, list(own.values()), metric).withColumnRenamed("sample_id", "neighbour_id")
    return _met(queries.select("sample_id", *names), found, names).select("sample_id", "neighbour_id", *[F.col(n).alias(c) for c, n in own.items()], "place")


def nearest_by_burden(queries: DataFrame, patients: DataFrame, k: int = 5) -> DataFrame:
    """Up to five similar patients by burden difference."""
    return _nearest(queries, patients, {"age": AGE_WIDTH, "tmb": TMB_WIDTH}, ["tmb"], k,
                    ["mutation_count", "target_survival_months", "target_event"])


def with_burden_neighbours(queries: DataFrame, patients: DataFrame, k: int = 5) -> DataFrame:
    """The query rows, each with the number of its up to five similar patients by burden and their ids in order; none where
    age or burden is unknown. Neighbours are gathered per point, so no row is multiplied by them."""
    reach = {"age": AGE_WIDTH, "tmb": TMB_WIDTH}
    names = list(reach)
    found = nearest_of_all(queries, patients, names, "sample_id", k, metric=WithinRanges(list(reach.values()), [False, True]))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("place", "sample_id"))), lambda x: x["sample_id"])
    near = found.groupBy(*names).agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("closest"))
    met = queries.join(near, [queries[c].cast("double") == near[c] for c in names], "left")
    return met.select(*[queries[c] for c in queries.columns], F.coalesce("n", F.lit(0)).cast("bigint").alias("similar_patients_found"), "closest")


def nearest_by_age_and_burden(queries: DataFrame, patients: DataFrame, k: int = 8) -> DataFrame:
    """Up to eight patients, mutation count within 100 too, by age plus burden difference."""
    return _nearest(queries, patients, {"age": AGE_WIDTH, "tmb": TMB_WIDTH, "mutation_count": MUTATION_WIDTH}, ["age", "tmb"], k,
                    ["mutation_count", "target_survival_months", "target_category"])


def cohort_summary(neighbours: DataFrame) -> DataFrame:
    """Means and survival range over the neighbours of each patient."""
    survival = F.coalesce("target_survival_months", F.lit(0.0))
    return neighbours.groupBy("sample_id").agg(
        F.count("*").alias("cohort_size"),
        F.avg("age").alias("avg_age"),
        F.avg(F.bround("tmb", 1)).alias("avg_tmb"),
        F.avg(survival).alias("avg_survival"),
        F.min(survival).alias("min_survival"),
        F.max(survival).alias("max_survival"),
    )


def category_counts(neighbours: DataFrame, category: str) -> DataFrame:
    """Category -> count per patient; at most a handful of categories in each map."""
    counts = neighbours.where(F.col(category).isNotNull()).groupBy("sample_id", category).agg(
        F.count("*").alias("n"))
    return counts.groupBy("sample_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(category, "n")))).alias("categories"))


def map_text(column: str):
    """'LONG=3,SHORT=1' from a map, keys in order."""
    entries = F.sort_array(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


MARKER_COLUMNS = [f"{g.lower()}_expression" for g in C.SUBTYPE_MARKERS]


def subtype_centroids(genomic: DataFrame) -> DataFrame:
    """Mean marker profile per subtype, a natural set of query profiles (four rows)."""
    return genomic.groupBy(F.col("sclc_subtype").alias("query_subtype")).agg(
        *[F.round(F.avg(c), 6).alias(c) for c in MARKER_COLUMNS])


def count_similar_profiles(queries: DataFrame, genomic: DataFrame, query_id: str = "query_subtype") -> DataFrame:
    """Samples with any of the four markers within two units of the query profile."""
    return range_counts(genomic, queries, MARKER_COLUMNS, query_id, 2.0)


def nearest_profiles(queries: DataFrame, genomic: DataFrame, query_id: str = "query_subtype", k: int = 5) -> DataFrame:
    """Five closest samples per query profile with their subtype."""
    known = genomic.where(F.col("sclc_subtype").isNotNull() & (F.col("sclc_subtype") != "MIXED"))
    return nearest_rows(known, queries, MARKER_COLUMNS, "sample_id", query_id, k, carry="sclc_subtype")


def profile_agreement(hits: DataFrame, query_id: str = "query_subtype") -> DataFrame:
    """How many of the closest samples carry the predicted subtype."""
    return hits.groupBy(query_id).agg(
        F.count("*").alias("n_similar"),
        F.count_if(F.col("sclc_subtype") == F.col(query_id)).alias("n_matching"),
        F.min_by("sample_id", "place").alias("closest_id"),
    )


def _read_once(samples: DataFrame, genomic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides, computed once: cells, points and results are all taken from them."""
    stored = cut_lineage(samples)
    return stored, stored if genomic is samples else cut_lineage(genomic.select("sample_id", "sclc_subtype", *MARKER_COLUMNS))


def similar_profiles_of_all(samples: DataFrame, genomic: DataFrame) -> DataFrame:
    """For every sample the number of samples with any of the four markers within two units of its own."""
    samples, genomic = _read_once(samples, genomic)
    counts = counts_of_all(samples, genomic, dict.fromkeys(MARKER_COLUMNS, 2.0), any_of=True)
    return _met(samples, counts, MARKER_COLUMNS).select(*samples.columns, F.col("n").alias("samples_found"))


def nearest_profiles_of_all(samples: DataFrame, genomic: DataFrame, k: int = 5) -> DataFrame:
    """The k closest samples of a known subtype for every sample, one row each."""
    needed = samples.select("sample_id", "sclc_subtype", *MARKER_COLUMNS) if genomic is samples else samples.select("sample_id", *MARKER_COLUMNS)
    samples, genomic = _read_once(needed, needed if genomic is samples else genomic)
    known = genomic.where(F.col("sclc_subtype").isNotNull() & (F.col("sclc_subtype") != "MIXED"))
    found = nearest_of_all(samples, known, MARKER_COLUMNS, "sample_id", k, ["sclc_subtype"]).withColumnsRenamed(
        {"sample_id": "neighbour_id", "sclc_subtype": "neighbour_subtype"})
    return _met(samples.select("sample_id", *MARKER_COLUMNS), found, MARKER_COLUMNS).select("sample_id", "neighbour_id", "neighbour_subtype", "place", "distance")


def agreement_of_all(samples: DataFrame, genomic: DataFrame, predicted: str, k: int = 5) -> DataFrame:
    """The rows of ``samples`` with n_similar, n_matching, closest_id and the subtypes of their closest samples, of which
    those equal to the column ``predicted`` match. At most k neighbours are gathered per profile."""
    samples, genomic = _read_once(samples, genomic)
    known = genomic.where(F.col("sclc_subtype").isNotNull() & (F.col("sclc_subtype") != "MIXED"))
    found = nearest_of_all(samples, known, MARKER_COLUMNS, "sample_id", k, ["sclc_subtype"])
    near = found.groupBy(*MARKER_COLUMNS).agg(F.sort_array(F.collect_list(F.struct("place", "sample_id", "sclc_subtype"))).alias("_near"))
    return _met(samples, near, MARKER_COLUMNS).select(
        *samples.columns, F.size("_near").cast("bigint").alias("n_similar"),
        F.size(F.filter("_near", lambda x: x["sclc_subtype"] == F.col(predicted))).cast("bigint").alias("n_matching"),
        F.col("_near")[0]["sample_id"].alias("closest_id"),
        F.array_join(F.transform("_near", lambda x: x["sclc_subtype"]), ",").alias("near_subtypes"))


def subtype_analysis_of_all(genomic: DataFrame, samples: DataFrame, predicted: str = "sclc_subtype", also: Sequence[str] = ()) -> DataFrame:
    """Prediction, marker summary, similar-profile count and prompt of every sample in one row."""
    markers = {g: F.col(f"{g.lower()}_expression") for g in C.SUBTYPE_MARKERS}
    n = F.col("samples_found").cast("string")
    return similar_profiles_of_all(samples, genomic).select(
        "sample_id", F.col(predicted).alias("predicted_subtype"), *also, *M.marker_summary(markers), "samples_found",
        F.concat(F.lit("Found "), n, F.lit(" samples with similar biomarker expression patterns")).alias("message"),
        subtype_prompt(F.col(predicted)).alias("prompt"), F.lit("full_subtype_analysis").alias("analysis_type"))


def subtype_flow_of_all(samples: DataFrame, genomic: DataFrame, predicted: str = "sclc_subtype") -> DataFrame:
    """Factor dominance, fit per subtype and agreement of the closest samples for every sample."""
    markers = {g: F.col(f"{g.lower()}_expression") for g in C.SUBTYPE_MARKERS}
    fits = [points.alias(f"fit_{s[-1].lower()}") for s, points in M.compatibility(markers).items()]
    return agreement_of_all(samples, genomic, predicted).select(
        "sample_id", F.col(predicted).alias("predicted_subtype"), *M.factor_dominance(markers), *fits, "n_similar", "n_matching", "closest_id",
        "near_subtypes")


def risk_analysis(patients: DataFrame, cohort: DataFrame, score: str = "risk_score") -> DataFrame:
    """Score, level, cohort count and prompt per patient in one row."""
    n = F.col("similar_patients_found").cast("string")
    return with_similar_count(patients, cohort).select(
        "sample_id", F.col(score).alias("risk_score"),
        lookups.risk_level(F.col(score)).alias("risk_level"),
        "similar_patients_found",
        F.concat(F.lit("Found "), n, F.lit(" similar patients in database")).alias("message"),
        risk_prompt(F.col(score)).alias("prompt"),
        F.lit("full_agentic_workflow").alias("analysis_type"),
    )


def _sex():
    return F.when(F.col("is_male") == 1, "Male").otherwise("Female")


def risk_prompt(score):
    """Text for a hosted language model; no model is called here."""
    return F.format_string(
        "Small cell lung cancer patient. Risk score %.3f of 100. Age %s. Sex %s. TMB %.3f per Mb. Mutations %d. "
        "Assess the risk, its drivers, treatment and outlook in a few sentences.",
        score, F.coalesce(F.col("age").cast("string"), F.lit("unknown")), _sex(), F.col("tmb"), F.col("mutation_count"))


def subtype_prompt(predicted):
    return F.format_string(
        "Subtype %s. ASCL1 %.4f, NEUROD1 %.4f, POU2F3 %.4f, YAP1 %.4f, TP53 %.4f, RB1 %.4f, MYC family %.4f. "
        "Report interpretation, key markers, alternatives, therapy and outlook.",
        predicted, *[F.col(c) for c in MARKER_COLUMNS], F.col("tp53_expression"), F.col("rb1_expression"),
        F.col("myc_family_score"))


def centre_prompt(city, region, level):
    return F.concat(
        F.lit("List 5 cancer treatment centers near "), city, F.lit(", "), region,
        F.lit(" for small cell lung cancer; prefer centers suited to "), level, F.lit(" patients."))


def subtype_analysis(genomic: DataFrame, profiles: DataFrame, query_id: str = "query_subtype") -> DataFrame:
    """Marker summary, similar-profile count and prompt per query profile."""
    markers = {g: F.col(f"{g.lower()}_expression") for g in C.SUBTYPE_MARKERS}
    counts = count_similar_profiles(profiles, genomic, query_id)
    n = F.col("n").cast("string")
    return profiles.join(counts, query_id).select(
        query_id, *M.marker_summary(markers), F.col("n").alias("samples_found"),
        F.concat(F.lit("Found "), n, F.lit(" samples with similar biomarker expression patterns")).alias("message"),
        F.lit("full_subtype_analysis").alias("analysis_type"),
    )


def risk_flow(patients: DataFrame, cohort: DataFrame, score: str = "risk_score") -> DataFrame:
    """Score, eight nearest patients with survival and categories, protocol."""
    hits = nearest_by_age_and_burden(patients, cohort)
    summary = hits.groupBy("sample_id").agg(
        F.count("*").alias("n_similar"), F.avg("target_survival_months").alias("avg_survival"))
    levelled = patients.select("sample_id", lookups.risk_level(F.col(score), "agent").alias("risk_level"))
    return (
        lookups.with_protocol(levelled).join(summary, "sample_id", "left")
        .join(category_counts(hits, "target_category"), "sample_id", "left")
        .select("sample_id", "risk_level", "protocol", F.coalesce("n_similar", F.lit(0)).alias("n_similar"),
                "avg_survival", map_text("categories").alias("categories"))
    )


def subtype_flow(profiles: DataFrame, genomic: DataFrame, query_id: str = "query_subtype") -> DataFrame:
    """Factor dominance, agreement of the nearest samples, and fit per subtype."""
    markers = {g: F.col(f"{g.lower()}_expression") for g in C.SUBTYPE_MARKERS}
    agreement = profile_agreement(nearest_profiles(profiles, genomic, query_id), query_id)
    fits = [points.alias(f"fit_{s[-1].lower()}") for s, points in M.compatibility(markers).items()]
    return profiles.select(query_id, *M.factor_dominance(markers), *fits).join(agreement, query_id)
