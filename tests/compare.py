"""Side-by-side comparison of a Spark result and its DuckDB check."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb
from pyspark.sql import DataFrame

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return ("float", repr(value))
    if isinstance(value, int):
        return ("int", value)
    return value


def rows_of_spark(df: DataFrame):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_duckdb(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted((tuple(_plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    return sorted(names), rows


def difference(df: DataFrame, con, sql: str) -> str | None:
    """None when equal, else a short account of the first difference."""
    left_names, left = rows_of_spark(df)
    right_names, right = rows_of_duckdb(con, sql)
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        extra = [r for r in left if r not in set(right)][:2], [r for r in right if r not in set(left)][:2]
        return f"rows {len(left)} != {len(right)}: {extra}"
    for a, b in zip(left, right):
        if a != b:
            return f"{left_names}\n  spark  {a}\n  duckdb {b}"
    return None
