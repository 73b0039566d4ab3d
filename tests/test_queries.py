"""Every query with SQL gives the same rows as that SQL, on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from citeloom.plans import catalog
from tests.conftest import DATA


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    r = db.sql(sql)
    assert sorted(r.columns) == cols
    want = sorted(repr([plain(x[r.columns.index(c)]) for c in cols]) for x in r.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
