"""Name -> (job, checking SQL)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixmart.plans.warehouse import Warehouse
from helixmart.sources.adapters import ADAPTERS

JOBS: dict[str, Callable[[Warehouse], DataFrame]] = {}
CHECKS: dict[str, str] = {}
# Views of the checking SQL, in dependency order.
CHECK_VIEWS: dict[str, str] = dict(ADAPTERS)


def job(name: str, check: str | None = None):
    """Register a job; ``check`` is SQL over the base tables and the CHECK_VIEWS."""

    def keep(fn: Callable[[Warehouse], DataFrame]):
        if name in JOBS:
            raise ValueError(f"job {name} is registered twice")
        JOBS[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return keep


def with_views(body: str) -> str:
    """Put the views that ``body`` needs, directly or through others, in front of it."""
    needed: set[str] = set()
    texts = [body]
    while texts:
        words = set(re.findall(r"[a-z_0-9]+", texts.pop()))
        for name in words & CHECK_VIEWS.keys() - needed:
            needed.add(name)
            texts.append(CHECK_VIEWS[name])
    if not needed:
        return body.strip()
    views = ",\n".join(f"{n} AS ({CHECK_VIEWS[n].strip()})" for n in CHECK_VIEWS if n in needed)
    return f"WITH {views}\n{body.strip()}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, folder: fn(Warehouse(spark, folder))

    return {name: bind(fn) for name, fn in JOBS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(body) for name, body in CHECKS.items()}
