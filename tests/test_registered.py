"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as registered
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_names():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    assert registered.entry(spark).count() == 20


@pytest.mark.parametrize("name", list(registered.queries()))
def test_query(spark, db, name):
    df = registered.queries()[name](spark, SF)
    rows = rows_of(df.columns, df.collect())
    if name in registered.oracle_sql():
        found = db.sql(registered.oracle_sql()[name])
        assert sorted(df.columns) == sorted(found.columns)
        assert rows == rows_of(found.columns, found.fetchall())
    assert rows
