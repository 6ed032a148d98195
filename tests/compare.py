"""Run a job in Spark and its checking SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import re
import sys
import time
from collections import Counter

import duckdb

from helixmart.sources.adapters import BASE_TABLES


def cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def duck(folder: str):
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


_KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "array<float>": "FLOAT[]",
}


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


def unscalable(df) -> str | None:
    """Cross joins, and windows that put a whole table in one task."""
    text = plan(df)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if word in text:
            return f"plan has {word}"
    for line in text.splitlines():
        # Ordered by a histogram bucket only, the window sees at most one row per bucket.
        if "Window [" in line and re.search(r"windowspecdefinition\((?!_b#)\w+#\d+L? (ASC|DESC)", line):
            return f"plan has a window without a partition: {line[:200]}"
    return None


def compare(spark, con, folder: str, fn, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    frame = fn(spark, folder)
    bad_plan = unscalable(frame)
    if bad_plan:
        return bad_plan
    names = sorted(frame.columns)
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    mine = Counter(tuple(cell(row[n]) for n in names) for row in frame.collect())
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    theirs_kinds = {d[0]: str(d[1]) for d in result.description}
    rows = result.fetchall()
    if sorted(theirs_names) != names:
        return f"columns {names} != {sorted(theirs_names)}"
    order = [theirs_names.index(n) for n in names]
    theirs = Counter(tuple(cell(row[i]) for i in order) for row in rows)
    wrong = [f"{n}: {kinds[n]} / {theirs_kinds[n]}" for n in names
             if _KIND.get(kinds[n], kinds[n]).upper() != theirs_kinds[n].upper()]
    if wrong:
        return f"types {wrong}"
    if mine != theirs:
        left, right = mine - theirs, theirs - mine
        return (f"rows {sum(mine.values())} / {sum(theirs.values())}, only Spark {sum(left.values())}, only SQL "
                f"{sum(right.values())}\n   {sorted(left)[:2]}\n   {sorted(right)[:2]}")
    if not rows:
        return "EMPTY"
    return None


def main(argv: list[str]) -> int:
    from helixmart.plans import oracle_sql, queries
    from helixmart.session import get_session

    folder = argv[1]
    patterns = argv[2:]
    spark, con = get_session(), duck(folder)
    jobs, checks, bad = queries(), oracle_sql(), 0
    for name, fn in jobs.items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        start = time.time()
        try:
            if name in checks:
                verdict = compare(spark, con, folder, fn, checks[name])
            else:
                verdict = None if fn(spark, folder).count() else "EMPTY"
        except Exception as exc:  # noqa: BLE001 - the report goes on with the next job
            verdict = f"{type(exc).__name__}: {str(exc)[:600]}"
        mark = "ok  " if verdict is None else "BAD "
        bad += verdict is not None
        print(f"{mark}{name} {time.time() - start:.1f}s {'' if name in checks else '(rows only)'} {verdict or ''}", flush=True)
    print(f"{bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
