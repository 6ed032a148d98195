"""Lazy layer of landed tables, staging views and marts over one data directory."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession

from helixmart.operators import marts, quality, staging
from helixmart.sources import tables

_MODELS = {
    "stg_clinical": lambda w: staging.clinical(w["clinical_data"]),
    "stg_gene_expression": lambda w: staging.gene_expression(w["gene_expression"]),
    "stg_experiments": lambda w: staging.experiments(w["experiments"]),
    "stg_dose_response": lambda w: staging.dose_response(w["dose_response"]),
    "cell_line_subtypes": lambda w: staging.cell_line_subtypes(w["cell_lines"]),
    "core_biomarkers": lambda w: marts.biomarkers(w["stg_gene_expression"]),
    "gene_summary": lambda w: marts.gene_summary(w["stg_gene_expression"]),
    "mart_risk_features_clinical": lambda w: marts.risk_features_clinical(w["stg_clinical"]),
    "genomic_features": lambda w: marts.genomic_features(w["core_biomarkers"]),
    "mart_risk_features_genomic": lambda w: marts.risk_features_genomic(w["genomic_features"], w["gene_summary"]),
    # The combined mart takes no median, so it joins the moments alone unless the genomic mart is stored.
    "mart_risk_features_combined": lambda w: marts.risk_features_combined(
        w["mart_risk_features_clinical"],
        w["mart_risk_features_genomic"] if w.is_stored("mart_risk_features_genomic")
        else marts.risk_features_genomic(w["genomic_features"], marts.gene_moments(w["stg_gene_expression"]))),
    "mart_drug_sensitivity": lambda w: marts.drug_sensitivity(
        w["stg_experiments"], staging.compounds(w["compounds"]), staging.cell_lines(w["cell_lines"])),
    "mart_drug_subtype_profile": lambda w: marts.drug_subtype_profile(
        w["mart_drug_sensitivity"], w["cell_line_subtypes"]),
    "top_drugs": lambda w: marts.top_drugs(w["mart_drug_subtype_profile"]),
    "mart_treatment_recommendations": lambda w: marts.treatment_recommendations(
        w["genomic_features"], w["top_drugs"]),
    "mart_dose_response_summary": lambda w: marts.dose_response_summary(
        w["stg_dose_response"], w["stg_experiments"]),
}
MATERIALISED = [name for name in _MODELS if name.startswith(("mart_", "core_"))]


class Warehouse:
    """``w[name]`` is a base table, an adapted landed table or a model, all lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}
        self._stored: set[str] = set()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in _MODELS:
                frame = _MODELS[name](self)
            elif name in tables.BASE_TABLES:
                frame = tables.base_table(self.spark, self.folder, name)
            else:
                frame = tables.adapted(self.spark, self.folder, name)
            self._frames[name] = frame
        return self._frames[name]

    def replace(self, name: str, frame: DataFrame) -> None:
        """Let models that are not made yet read ``frame`` under this name."""
        self._frames[name] = frame

    def use_stored(self, name: str, frame: DataFrame) -> None:
        """Let later models read the stored form of a table."""
        self._frames[name] = frame
        self._stored.add(name)

    def is_stored(self, name: str) -> bool:
        return name in self._stored


def build(w: Warehouse, target: str, names: Iterable[str] = MATERIALISED, observed: dict[str, Observation] | None = None) -> dict[str, str]:
    """Write the table models below ``target`` in dependency order; views stay lazy.

    Later models read the stored form of the earlier ones, so each is computed once
    and a lost executor costs one model at most. The genomic mart reads the expression rows
    several times, so these are joined and cleaned once and stored beside the marts.
    """
    written = {}
    names = set(names)
    if "mart_risk_features_genomic" in names:
        _store_genes(w, f"{target.rstrip('/')}/stg_gene_expression")
    for name in [n for n in _MODELS if n in names]:
        path = f"{target.rstrip('/')}/{name}"
        frame = _watched(w[name], name, observed) if observed is not None else w[name]
        frame.write.mode("overwrite").parquet(path)
        w.use_stored(name, w.spark.read.parquet(path))
        written[name] = path
    return written


def _store_genes(w: Warehouse, path: str) -> None:
    """Store the expression rows, those of a sample mostly together, so that later groupings shuffle little more than a row
    per sample. A rebalance, not a repartition: adaptive execution cuts the rows of a large sample into several tasks."""
    rows = w["stg_gene_expression"].select("gene_symbol", "sample_id", "expression_value")
    rows.hint("rebalance", "sample_id").write.mode("overwrite").parquet(path)
    w.replace("stg_gene_expression", staging.graded(w.spark.read.parquet(path)))


def _watched(frame: DataFrame, name: str, observed: dict[str, Observation]) -> DataFrame:
    checks = quality.observed_checks().get(name)
    if checks is None:
        return frame
    observed[name] = Observation(f"{name} checks")
    return frame.observe(observed[name], *[column.alias(f"m{i}") for i, column in enumerate(checks.values())])


def _same_settings(spark: SparkSession) -> SparkSession:
    """A new session with the settings that ``spark`` has by now, such as its number of shuffle partitions."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def build_observed(w: Warehouse, target: str) -> DataFrame:
    """``build`` all marts; the checks of ``quality.observed_checks`` ride on the scans and writes that this takes anyway.

    A landed table or view is observed where a mart first reads it, a mart where it is written, so nothing is scanned
    again for its checks. Returns (check_name, key, value), as many rows as there are checks.

    The build runs in a session of its own, with the settings of the given one: a session that has observed metrics cannot
    be sent with a task any more, which evaluators of Spark ML do.
    """
    observed: dict[str, Observation] = {}
    own = Warehouse(_same_settings(w.spark), w.folder)
    for name in quality.observed_checks():
        if name not in MATERIALISED:
            own.replace(name, _watched(own[name], name, observed))
    for name, path in build(own, target, observed=observed).items():
        w.use_stored(name, w.spark.read.parquet(path))
    rows = []
    for name, checks in quality.observed_checks().items():
        found = observed[name].get
        rows += [(check, key, float(found[f"m{i}"])) for i, (check, key) in enumerate(checks)]
    return quality.observed_report(w.spark, rows)
