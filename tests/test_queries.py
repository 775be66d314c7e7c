"""Every query with SQL gives the same rows in DuckDB on the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

from vellum.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v if v is None or isinstance(v, (bool, int, str)) else plain(v.item()) if hasattr(v, "item") else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    result = duck.sql(ORACLES[name])
    columns = result.columns
    assert sorted(columns) == names
    want = sorted((tuple(plain(row[columns.index(n)]) for n in names) for row in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
