"""Every raster query with a SQL twin gives the twin's rows, on the smallest tables."""

import duckdb
import pytest

from tidewright.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _value(x):
    if x is None or x != x:
        return "None"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(cols, found):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    made = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert sorted(made.columns) == sorted(want.columns)
    assert rows(made.columns, made.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
