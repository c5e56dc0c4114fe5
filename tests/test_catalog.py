"""Every query of the catalog against its SQL on a second engine."""

import glob
import math
import os

import duckdb
import pytest

from drivelake.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.5g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted([plain(r[c]) for c in names] for r in df.select(*names).collect())
    cur = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    want = sorted([plain(r[columns.index(c)]) for c in names] for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_without_sql_run_and_repeat(spark, name):
    first = [tuple(r) for r in QUERIES[name](spark, SF).collect()]
    again = [tuple(r) for r in QUERIES[name](spark, SF).collect()]
    assert sorted(map(str, first)) == sorted(map(str, again))
