import duckdb
import pytest

from citeloom.llm import catalog
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(repr([r[c] for c in cols]) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        c = duckdb.connect()
        for t in DATA.glob("*.parquet"):
            c.sql(f"create view {t.stem} as select * from '{t}'")
        r = c.sql(sql)
        assert got == sorted(repr([x[r.columns.index(k)] for k in cols]) for x in r.fetchall())
