"""Registered queries against their SQL in DuckDB, at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert {*entry.oracle_sql()} <= {*entry.queries()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns) and len(got) == len(want)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (c, got[~same].head(), want[~same].head())


@pytest.mark.parametrize("name", sorted({*entry.queries()} - {*entry.oracle_sql()} - {"pipeline"}))
def test_query_without_sql_runs(spark, name):
    if name.startswith("op"):
        pytest.skip("held against brute force with its operator")
    assert entry.queries()[name](spark, SF).count() > 0
