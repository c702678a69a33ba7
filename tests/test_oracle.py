"""Every query with SQL gives DuckDB's rows on the smallest tables; every other one runs."""

import glob
import os

import duckdb
import pytest

from quire.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x != x:
        return "None"
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x).removesuffix(" 00:00:00")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert rows
        return
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall())
