"""Every query runs on the smallest tables, and where there is SQL, DuckDB gives the same rows."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
QUERIES = {k: q for k, q in entry.queries().items() if not k.startswith("op") and k != "pipeline"}


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    rows = sorted(map(repr, ([plain(v) for v in r] for r in df.select(*names).collect())))
    assert rows or name in ("match_ambiguous",)
    sql = entry.oracle_sql().get(name)
    if sql:
        got = tables.execute(sql)
        columns = [d[0] for d in got.description]
        assert sorted(columns) == names
        assert sorted(map(repr, ([plain(r[columns.index(n)]) for n in names] for r in got.fetchall()))) == rows


def test_flagship(spark):
    assert entry.entry(spark).columns == ["sample", "mm0", "mm1"]
