"""Runs registered queries next to their SQL in DuckDB and compares whole results."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return str(value.date()) if value.time() == datetime.time() else str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


# Spark type names for the DuckDB types the queries return.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
         "BOOLEAN": "boolean", "HUGEINT": "hugeint"}


def compare(df, con, sql: str) -> list[str]:
    """Problems found; empty when names, types, counts and values agree."""
    problems = []
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in cur.description}
    theirs = cur.fetchall()
    ours = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    for name, spark_type in df.dtypes:
        if spark_type != types[name]:
            problems.append(f"type of {name}: {spark_type} vs {types[name]}")
    a, b = rows_of(df.columns, ours), rows_of(names, theirs)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} vs {len(b)}")
    if not a:
        problems.append("no rows")
    if a != b:
        sa, sb = set(a), set(b)
        only_a, only_b = sorted(sa - sb), sorted(sb - sa)
        problems.append(f"{len(only_a)} rows differ; columns {sorted(names)}; e.g. {only_a[:2]} vs {only_b[:2]}")
    return problems
