"""Comparison of a query with its SQL over the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _key(r):
    return tuple(f"{float(v):.6f}" if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v).replace("+00:00", "") for v in r)


def check(spark, con, name):
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(_key, want.fetchall())) == sorted(map(_key, got.select(*columns).collect()))
