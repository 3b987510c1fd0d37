"""Runs a query in Spark and its SQL in DuckDB, and holds the rows against each other."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in data)


def compare(spark, sf_dir: str, query, sql: str, con=None) -> int:
    """Number of rows, if columns and rows are the same."""
    df = query(spark, sf_dir)
    got = df.collect()
    found = (con or connect(sf_dir)).execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns), (df.columns, columns)
    have, want = rows(df.columns, got), rows(columns, found.fetchall())
    assert have == want, (list((have - want).items())[:5], list((want - have).items())[:5])
    return len(got)
