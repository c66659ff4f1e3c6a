import glob
import math
import os
from collections import Counter
from decimal import Decimal

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"

PROBLEMS = [n for n in entry.queries() if n[0] == "p" and n[1:2].isdigit() and not n.startswith("p4_")]


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 4) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the small tables are not here")
@pytest.mark.parametrize("name", PROBLEMS)
def test_problem(spark, name):
    import duckdb

    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    if name not in entry.oracle_sql():
        return
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(tuple(map(cell, r)) for r in rows) == Counter(tuple(cell(r[columns.index(c)]) for c in df.columns) for r in got.fetchall())


def test_every_problem_has_its_found_query():
    assert {f"p{n}_found" for n in range(1, 11)} <= entry.queries().keys()
