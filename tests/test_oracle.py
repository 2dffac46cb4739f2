"""Every registered query against its SQL, over the whole small tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def _rows(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted(tuple(_cell(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    assert got
    if name not in ORACLES:
        return
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    names = sorted(df.columns)
    assert names == sorted(columns)
    assert _rows(got, df.columns, names) == _rows(want, columns, names)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
