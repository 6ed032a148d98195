"""Formulas over the subtype markers and the target genes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from helixmart.functions.constants import MARKER_SUBTYPE, MATRIX_MARKERS, SUBTYPE_MARKERS
from helixmart.functions.rules import flag, unless_null, zero


def others(markers: dict[str, Column], name: str) -> list[Column]:
    return [column for other, column in markers.items() if other != name]


def subtype_call(markers: dict[str, Column]) -> Column:
    """Subtype of the marker that is strictly above the other three, else MIXED."""
    out = F
    for gene, subtype in MARKER_SUBTYPE.items():
        out = out.when(markers[gene] > F.greatest(*others(markers, gene)), F.lit(subtype))
    return out.otherwise(F.lit("MIXED"))


def confidence_gap(markers: dict[str, Column], corrected: bool = False) -> Column:
    """Leading marker minus the runner-up.

    By default the runner-up is subtracted only where ASCL1 leads; ``corrected``
    subtracts it for every subtype.
    """
    top = F.greatest(*markers.values())
    if corrected:
        ranked = F.sort_array(F.array(*markers.values()), asc=False)
        return ranked[0] - ranked[1]
    rest = F.greatest(*others(markers, "ASCL1"))
    return top - F.when(markers["ASCL1"] >= rest, rest).otherwise(F.lit(0.0))


def dual_loss(tp53: Column, rb1: Column, cut: float = 5) -> Column:
    return flag((zero(tp53) < cut) & (zero(rb1) < cut))


def leading_marker(markers: dict[str, Column], order: list[str]) -> Column:
    """Name of the largest marker; ties go to the first in ``order``; NULL if one is missing."""
    top = F.greatest(*markers.values())
    out = F
    for gene in order[:-1]:
        out = out.when(markers[gene] == top, F.lit(gene))
    return unless_null(list(markers.values()), out.otherwise(F.lit(order[-1])))


def max_marker_label(markers: dict[str, Column]) -> Column:
    """Subtype of the largest present marker; ties go to the first matrix column."""
    top = F.greatest(*[markers[g] for g in MATRIX_MARKERS])
    out = F
    for gene in MATRIX_MARKERS:
        out = out.when(markers[gene] == top, F.lit(MARKER_SUBTYPE[gene]))
    return out.otherwise(F.lit("Unclassified"))


def marker_summary(markers: dict[str, Column]) -> list[Column]:
    a, n, p, y = (markers[g] for g in SUBTYPE_MARKERS)
    values = list(markers.values())
    return [
        leading_marker(markers, SUBTYPE_MARKERS).alias("dominant_tf"),
        unless_null(values, F.greatest(*values)).alias("dominant_value"),
        ((a + n) / 2.0).alias("ne_score"),
        ((p + y) / 2.0).alias("non_ne_score"),
    ]


def factor_dominance(markers: dict[str, Column]) -> list[Column]:
    """Leading factor, its ratio to the mean of the other three, and the NE class."""
    a, n, p, y = (markers[g] for g in SUBTYPE_MARKERS)
    top = F.greatest(*markers.values())
    rest = (a + n + p + y - top) / 3.0
    return [
        leading_marker(markers, SUBTYPE_MARKERS).alias("dominant_tf"),
        top.alias("dominant_value"),
        F.when(rest > 0, top / rest).otherwise(top).alias("dominance_ratio"),
        F.when(a + n > p + y, F.lit("Neuroendocrine")).otherwise(F.lit("Non-Neuroendocrine")).alias("nature"),
        (a + n).alias("ne_sum"),
        (p + y).alias("non_ne_sum"),
    ]


def compatibility(markers: dict[str, Column]) -> dict[str, Column]:
    """0-100 points per subtype: 40 high, 30 dominant, 15 + 15 for low competitors."""
    low = {gene: column < 8 for gene, column in markers.items()}
    both = {"SCLC-A": ("NEUROD1",), "SCLC-N": ("ASCL1",), "SCLC-P": ("ASCL1", "NEUROD1"), "SCLC-Y": ("ASCL1", "NEUROD1")}
    last = {"SCLC-A": ("POU2F3", "YAP1"), "SCLC-N": ("POU2F3", "YAP1"), "SCLC-P": ("YAP1",), "SCLC-Y": ("POU2F3",)}

    def every(genes: tuple[str, ...]) -> Column:
        out = low[genes[0]]
        for gene in genes[1:]:
            out = out & low[gene]
        return out

    return {
        subtype: (
            flag(markers[gene] > 10) * 40
            + flag(markers[gene] > F.greatest(*others(markers, gene))) * 30
            + flag(every(both[subtype])) * 15
            + flag(every(last[subtype])) * 15
        )
        for gene, subtype in MARKER_SUBTYPE.items()
    }


def serving_biomarkers(genes: list[Column], tp53: Column, rb1: Column, myc: list[Column]) -> list[Column]:
    """Feature formulas of the serving side, which differ from the training mart."""
    values = F.array(*genes)
    size = float(len(genes))
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    mean = total / size
    spread = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return [
        (myc[0] + myc[1] + myc[2]).alias("myc_family_sum"),
        flag((tp53 < 6) & (rb1 < 6)).alias("dual_loss_serving"),
        mean.alias("mean_nine"),
        F.sqrt(spread / size).alias("std_nine"),
        F.size(F.filter(values, lambda x: x > 5)).alias("genes_over_5"),
    ]
