"""Every registered query against its DuckDB equivalent on the smallest data set."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        assert compare(got, duck.execute(sql).df()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
