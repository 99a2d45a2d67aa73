import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from leafgrid import catalogue

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda x: round(x, 8) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df, other = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(other.fetchall(), other.columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
