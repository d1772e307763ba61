"""The driver contract: entry, queries and SQL, held against each other."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as contract
from weftwork import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def values(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda x: repr(round(float(x), 9)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, sf, name):
    mine, want = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(mine.columns) == sorted(want.columns)
    assert values(mine) == values(want)
