"""Runs a registered query and its DuckDB text and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return str(value)


def bag(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, connection, sql: str) -> tuple[list[str], Counter, Counter]:
    """Column names that differ, rows only in Spark's result, rows only in DuckDB's."""
    theirs = connection.execute(sql)
    names = [d[0] for d in theirs.description]
    expected = bag(theirs.fetchall(), names)
    got = bag([tuple(r) for r in df.collect()], df.columns)
    return sorted(set(names) ^ set(df.columns)), got - expected, expected - got
