"""Compare a Spark result with its SQL twin, value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
WIDTHS = {"bigint": "long", "double": "double", "varchar": "string", "date": "date", "boolean": "boolean"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def constant_columns(rows, names) -> set[str]:
    """Columns that hold the same value in every one of several rows."""
    if len(rows) < 2:
        return set()
    return {n for i, n in enumerate(names) if len({repr(plain(r[i])) for r in rows}) == 1}


def differences(spark_df, con, sql: str, rows: list | None = None) -> list[str]:
    """Empty when schema, row count and all values agree. ``rows`` takes what
    Spark returned."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: WIDTHS.get(str(d[1]).lower(), str(d[1]).lower()) for d in result.description}
    expected = canonical(result.fetchall(), names)
    found = [tuple(r) for r in spark_df.collect()]
    if rows is not None:
        rows.extend(found)
    got = canonical(found, spark_df.columns)
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        problems.append(f"columns {sorted(spark_df.columns)} vs {sorted(names)}")
    kinds = {f.name: f.dataType.typeName() for f in spark_df.schema}
    wrong = {n: (kinds.get(n), t) for n, t in types.items() if kinds.get(n) != t}
    if wrong:
        problems.append(f"types {wrong}")
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} vs {len(expected)}")
    if got != expected:
        missing = [r for r in expected if r not in set(got)][:2]
        extra = [r for r in got if r not in set(expected)][:2]
        problems.append(f"sql only {str(missing)[:600]} spark only {str(extra)[:600]}")
    return problems
