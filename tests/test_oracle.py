"""Every registered query equals its DuckDB oracle at sf0.01 (exact values)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001

@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF001):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF001}/{name}')")
    return c


def _norm(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return v


def _key(r):
    return tuple((x is None, "" if x is None else (repr(x) if isinstance(x, float) else str(x))) for x in r)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    got = sorted([tuple(_norm(x) for x in r) for r in df.collect()], key=_key)
    res = con.sql(E.oracle_sql()[name])
    assert df.columns == res.columns
    want = sorted([tuple(_norm(x) for x in r) for r in res.fetchall()], key=_key)
    assert len(got) == len(want)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["method", "metric", "year", "value"]
    assert df.count() >= 0
