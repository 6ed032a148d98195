"""Small column rules shared by the models."""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def band(value: Column, bands: Sequence[tuple], rest=None) -> Column:
    """First matching (comparison, cut, label) wins; NULL and no match give ``rest``."""
    out = F
    for comparison, cut, label in bands:
        out = out.when(_COMPARE[comparison](value, F.lit(cut)), F.lit(label))
    return out.otherwise(F.lit(rest))


def first_like(columns: Sequence[Column], rules: Sequence[tuple[str, str]], rest: str) -> Column:
    """Label of the first pattern that any of the columns matches."""
    out = F
    for pattern, label in rules:
        hit = columns[0].like(pattern)
        for other in columns[1:]:
            hit = hit | other.like(pattern)
        out = out.when(hit, F.lit(label))
    return out.otherwise(F.lit(rest))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def one_hot(value: Column, names: dict[str, str]) -> list[Column]:
    """One 0/1 column per {column name: category}."""
    return [flag(value == category).alias(name) for name, category in names.items()]


def norm_key(value: Column) -> Column:
    return F.upper(F.trim(value))


def to_double(value: Column) -> Column:
    """Safe cast: text that is no finite number gives NULL, so "NaN" and "Infinity" spoil no mean or rank."""
    number = value.try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)  # NaN is above infinity in Spark's order


def to_bigint(value: Column) -> Column:
    """Safe integer cast that rounds decimals instead of dropping the value."""
    return F.round(value.try_cast("decimal(38,10)")).cast("bigint")


def zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def unless_null(inputs: Sequence[Column], value: Column) -> Column:
    """``value``, but NULL as soon as one input is NULL."""
    known = inputs[0].isNotNull()
    for item in inputs[1:]:
        known = known & item.isNotNull()
    return F.when(known, value)


def round_half_up(value: Column, digits: int, scale: int = 12) -> Column:
    """Round through a decimal, so that the last binary digit cannot move a half."""
    return F.round(value.cast(f"decimal(38,{scale})"), digits).cast("double")


def share(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL when whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
