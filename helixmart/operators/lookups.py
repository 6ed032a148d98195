"""Parametrised lookups, validity rules, reference texts and name searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from helixmart.functions import constants as C
from helixmart.functions.rules import band, flag, to_bigint


def risk_level(score: Column, profile: str = "warehouse") -> Column:
    return band(score, C.RISK_CUTS[profile], C.RISK_REST[profile])


def serving_features(staged: DataFrame) -> DataFrame:
    """Feature formulas of the scoring side: other TMB cuts, former instead of current smokers."""
    tmb = F.col("tmb")
    return staged.select(
        "sample_id",
        flag(tmb >= 20).alias("is_tmb_high"),
        flag((tmb >= 10) & (tmb < 20)).alias("is_tmb_intermediate"),
        flag(tmb < 10).alias("is_tmb_low"),
        F.when(F.col("smoking_status") == "FORMER", tmb).otherwise(F.lit(0.0)).alias("smoker_x_tmb"),
    )


def integer_casts(raw_experiments: DataFrame) -> DataFrame:
    return raw_experiments.select(
        "nsc",
        to_bigint(F.col("nsc").try_cast("double") / 8.0).alias("nsc_eighth"),
        to_bigint(F.col("log_ic50")).alias("log_ic50_int"),
    )


def prefix_hits(expression: DataFrame, clinical: DataFrame) -> DataFrame:
    """Genes by prefix and sample ids by infix."""
    gene = F.col("gene_symbol")
    wanted = F.lit(False)
    for prefix in C.GENE_PREFIXES:
        wanted = wanted | gene.like(f"{prefix}%")
    sample = F.col("sample_id")
    inside = F.lit(False)
    for pattern in ("%11A%", "%12A%", "%B08%", "%B10%", "%S1%00%"):
        inside = inside | sample.like(pattern)
    genes = expression.where(wanted).select(F.lit("gene").alias("kind"), gene.alias("hit")).distinct()
    samples = clinical.where(inside).select(F.lit("sample").alias("kind"), sample.alias("hit")).distinct()
    return genes.unionByName(samples)


def mentions(text: Column, terms: Sequence[str], longer_than: int) -> Column:
    """Any of the terms occurs (any case) in a text of more than ``longer_than`` characters."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | text.ilike(f"%{term}%")
    return text.isNotNull() & (F.length(text) > longer_than) & hit


def _dimension(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed in-code table; a handful of rows, so it is broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def with_subtype_texts(df: DataFrame) -> DataFrame:
    rows = [(s, *C.SUBTYPE_THERAPY[s], C.SUBTYPE_TARGETS[s]) for s in C.SUBTYPES]
    texts = _dimension(df, rows, "sclc_subtype string, nature string, marker string, therapy string, targets string")
    return df.join(texts, "sclc_subtype", "left").withColumn(
        "targets", F.coalesce("targets", F.lit(C.SUBTYPE_TARGET_REST)))


def with_protocol(df: DataFrame) -> DataFrame:
    rows = list(C.TREATMENT_PROTOCOLS.items())
    protocols = _dimension(df, rows, "risk_level string, protocol string")
    return df.join(protocols, "risk_level", "left").withColumn(
        "protocol", F.coalesce("protocol", F.lit(C.TREATMENT_PROTOCOL_REST)))


def with_validity(patients: DataFrame) -> DataFrame:
    """is_valid = 1 for rows inside the accepted input ranges; the rest goes to quarantine."""
    ok = F.col("age").between(0, 120) & (F.col("mutation_count") >= 0) & (F.col("tmb") >= 0)
    for name in ("is_male", "is_former_smoker", "is_tmb_high", "is_tmb_intermediate", "is_tmb_low"):
        ok = ok & F.col(name).isin(0, 1)
    return patients.withColumn("is_valid", flag(ok))


def markers_valid(values: Sequence[Column]) -> Column:
    ok = values[0].between(0, 20)
    for value in values[1:]:
        ok = ok & value.between(0, 20)
    return flag(ok)


def drugs_for(sensitivity: DataFrame, cell_line: str | None = None) -> DataFrame:
    return sensitivity if cell_line is None else sensitivity.where(F.col("cell_line") == F.lit(cell_line))


def recommendations_for(
    recommendations: DataFrame, sample_id: str | None = None, sclc_subtype: str | None = None
) -> DataFrame:
    out = recommendations
    if sample_id is not None:
        out = out.where(F.col("sample_id") == F.lit(sample_id))
    if sclc_subtype is not None:
        out = out.where(F.col("sclc_subtype") == F.lit(sclc_subtype))
    return out.orderBy("sample_id", "drug_rank")


def patient_profiles(clinical: DataFrame, genomic: DataFrame, sample_id: str | None = None) -> DataFrame:
    """Clinical row with subtype and markers; one id filters both sides before the join."""
    if sample_id is not None:
        clinical = clinical.where(F.col("sample_id") == F.lit(sample_id))
    columns = ["sample_id", "sclc_subtype", *[f"{g.lower()}_expression" for g in C.SUBTYPE_MARKERS]]
    return clinical.join(genomic.select(*columns), "sample_id", "left")


def field_formats(users: DataFrame) -> DataFrame:
    name = F.col("username")
    return users.withColumns({
        "username_ok": flag((F.length(name) >= 3) & name.rlike(C.USERNAME_PATTERN)),
        "email_ok": flag(F.col("email").rlike(C.EMAIL_PATTERN)),
    })


def route_question(question: Column) -> Column:
    """First keyword list with a hit names the table; NULL is left to the vector search."""
    lowered, out = F.lower(question), F
    for table, words in C.ROUTER_RULES:
        out = out.when(lowered.rlike("|".join(words)), F.lit(table))
    return out.otherwise(F.lit(None).cast("string"))


def scoring_defaults(df: DataFrame) -> DataFrame:
    """Missing flags count as 0; other features stay NULL for the median imputer."""
    return df.fillna(0, [name for name in df.columns if name.startswith("is_")])


def small_cell_lines(info: DataFrame) -> DataFrame:
    """Lung lines described as small cell. The text also matches "non-small cell"."""
    disease, subtype = F.coalesce("primary_disease", F.lit("")), F.coalesce("lineage_subtype", F.lit(""))
    return info.where(
        (F.col("lineage") == "lung") & (disease.rlike("(?i)small cell") | subtype.rlike("(?i)small cell|sclc")))


def _first_column(matches: DataFrame) -> DataFrame:
    return matches.groupBy("gene").agg(F.min_by("column_name", F.struct("worse", "position")).alias("column_name"))


def find_genes(columns: DataFrame, genes: Sequence[str]) -> DataFrame:
    """Matrix column of each gene: the exact name, else the name followed by " (id)"."""
    name = F.col("column_name")
    wanted = F.filter(F.array(*[F.lit(g) for g in genes]),
                      lambda g: (name == g) | name.startswith(F.concat(g, F.lit(" ("))))
    return _first_column(
        columns.select(F.explode(wanted).alias("gene"), "column_name", "position")
        .withColumn("worse", flag(F.col("column_name") != F.col("gene"))))


def genes_containing(columns: DataFrame, genes: Sequence[str]) -> DataFrame:
    """First matrix column, by position, whose name contains the gene in any case."""
    name = F.upper("column_name")
    wanted = F.filter(F.array(*[F.lit(g.upper()) for g in genes]), lambda g: name.contains(g))
    return _first_column(
        columns.select(F.explode(wanted).alias("gene"), "column_name", "position").withColumn("worse", F.lit(0)))
