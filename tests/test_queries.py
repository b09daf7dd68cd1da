"""Each query with SQL against DuckDB over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([rows_[i] for i in order]) for rows_ in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), names)


def test_entry(spark, sf):
    assert entry.entry(spark).count() == 1
