"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import os

import pytest

import __spark_entry__ as E

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    df = E.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = tables.execute(E.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want


def test_all_queries_are_callable_by_name():
    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) > 40


def test_entry(spark):
    assert E.entry(spark).count() > 0
