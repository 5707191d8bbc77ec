"""The driver contract: every query with SQL equals it on the smallest tables."""

from __future__ import annotations

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()
GRAPH = [k for k in SQL if not k.startswith("op")]


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", GRAPH)
def test_against_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    res = con.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()]
    order = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_entry_and_keys(spark):
    assert entry.entry(spark).columns and set(SQL) <= set(entry.queries())
