"""Runs a query in Spark and its SQL twin in DuckDB and compares their rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TESTDATA", "/root/testdata")


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> str:
    """Empty if both give the same rows."""
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    want = rows_of(columns, found.fetchall())
    have = rows_of(spark_df.columns, spark_df.collect())
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(columns)}"
    if have != want:
        a, b = [x for x in have if x not in set(want)][:3], [x for x in want if x not in set(have)][:3]
        return f"{len(have)} and {len(want)} rows; only Spark: {a}; only SQL: {b}"
    return ""
