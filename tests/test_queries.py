"""Every registered query against its SQL, on the smallest sample tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from panelspark.plans import sample_queries, sample_sql

SF_DIR = os.environ.get("SAMPLE_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables")

# The queries of this package; the driver's also hold those of the optional training-data operators.
QUERIES, SQL = sample_queries.all_queries(), sample_sql.all_sql()
WITHOUT_SQL = {"entity_sample_xxh64"}


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql()) <= set(driver.queries())


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{file}'")
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    expected = table(names, result.fetchall())
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_sample_by_xxh64(spark):
    df = QUERIES["entity_sample_xxh64"](spark, SF_DIR)
    md5 = QUERIES["entity_sample"](spark, SF_DIR)
    assert df.columns == md5.columns and df.count() == md5.count()
