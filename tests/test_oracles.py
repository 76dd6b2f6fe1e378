"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from codeloom.plans import QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("the test tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_value, v))
    return v


def _rows(rows):
    return sorted((tuple(map(_value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert _rows(tuple(r) for r in df.select(*cols).collect()) == _rows(duck.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())


def test_queries_without_sql_run(spark, duck):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, FOLDER).count() > 0
