"""Every query with SQL gives DuckDB's rows on the small tables; every other one gives rows or at least runs."""

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the small tables are not here")


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, Decimal)):
        return round(float(v), 4)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


CORE = [n for n in entry.queries() if not (n[0] == "p" and n[1:2].isdigit()) or n.startswith("p4_")]


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    if name not in entry.oracle_sql():
        return
    got = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(cell(r[columns.index(c)]) for c in df.columns) for r in got.fetchall())
    assert Counter(tuple(map(cell, r)) for r in rows) == want


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["contract_id", "link", "ordinal", "node_ref"] and df.count() > 0


def test_all_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
