"""Every query against its SQL on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry_module

DIR = "/root/testdata/sf0.001"
ORACLE = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(v) if isinstance(v, list) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    df = entry_module.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    said = con.sql(ORACLE[name])
    assert sorted(said.columns) == columns
    at = [said.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in said.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
