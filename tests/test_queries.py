"""Every graph query against its SQL on the smallest tables."""

import os

import pytest

from netframe import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = queries.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(cols, found):
    return sorted((tuple(r) for r in found), key=repr), cols


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows(cols, ((r[c] for c in cols) for r in df.collect())) == rows(cols, ([r[i] for i in at] for r in want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_other_queries_run(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
