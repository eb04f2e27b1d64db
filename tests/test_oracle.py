"""Each query of the engine's own operators gives the rows of its SQL."""

import glob
import os

import duckdb
import pytest

from caravel import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.sql(queries.ORACLES[name]).to_arrow_table()
    cols = sorted(got.columns)
    assert cols == sorted(want.column_names)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[c] for c in cols)) for r in want.to_pylist())
