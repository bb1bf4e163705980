"""Runs a query's SQL in DuckDB and compares rows regardless of order."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        return ("decimal", float(v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple((type(x).__name__, plain(x)) if x is not None else ("", "") for x in (r[i] for i in order)) for r in rows), key=repr)


def difference(spark_df, sql, con) -> str:
    found = con.sql(sql)
    names, have = sorted(found.columns), sorted(spark_df.columns)
    if names != have:
        return f"columns {have}, SQL {names}"
    a, b = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()]), rows_of(found.columns, found.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows, SQL {len(b)}; {[x for x in a if x not in b][:1]}; {[x for x in b if x not in a][:1]}" if max(len(a), len(b)) < 20000 else f"{len(a)} rows, SQL {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""
