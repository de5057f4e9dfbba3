"""Every flow query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from tidegauge.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.select(cols).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
