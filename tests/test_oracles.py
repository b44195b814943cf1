"""Every registered query that has SQL gives the same rows as DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from veridex.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
entry._library()


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        x = float(v)
        return None if math.isnan(x) else round(x, 5) + 0.0
    return str(v)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    key = lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, bool) else (True, "b", x) for x in r)
    want = sorted((tuple(canon(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=key)
    have = sorted((tuple(canon(r[c]) for c in order) for r in got.collect()), key=key)
    assert len(have) == len(want)
    assert have == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
