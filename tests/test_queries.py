"""Every registered query against its SQL in DuckDB on the smallest tables; streams among them."""

import glob
import math
import os

import duckdb
import pytest

from tidewatch.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rel = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*[f"`{x}`" for x in columns]).collect())
    at = [rel.columns.index(x) for x in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "class" in df.columns
