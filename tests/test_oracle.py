"""Every query with SQL gives the SQL's rows; the others give rows. Runs on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from studyloom.plans.oracle import ORACLE_SQL
from studyloom.plans.queries import ALL_TABLES, QUERIES


@pytest.fixture(scope="session")
def duck(sf001):
    c = duckdb.connect()
    for t in ALL_TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf001}/{t}.parquet'")
    return c


def rows_of(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df = df.assign(**{c: df[c].round(6)})
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf001, duck, name):
    got = QUERIES[name](spark, sf001).toPandas()
    if name not in ORACLE_SQL:
        assert len(got.columns)
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert {c: got[c].dtype.kind for c in got} == {c: want[c].dtype.kind for c in got} or not len(got)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
