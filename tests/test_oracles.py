"""Every registered query against its DuckDB statement, on the smallest tables."""

from __future__ import annotations

import os
from collections import Counter
from datetime import date, datetime
from functools import lru_cache

import duckdb
import pytest

from quern.plans import catalogue
from quern.session import TABLES as NAMES


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, date):
        return value.isoformat()
    if hasattr(value, "__index__") and not isinstance(value, bool):
        return int(value)
    return value


@lru_cache(maxsize=2)
def duck(tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        path = f"{tables}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def compare(name, spark, tables):
    df = catalogue.QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck(tables).sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(name, spark, tables):
    compare(name, spark, tables)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_oracle_runs(name, spark, tables):
    assert len(catalogue.QUERIES[name](spark, tables).collect()) > 0
