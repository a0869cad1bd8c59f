"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_sql import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    frame = entry.queries()[name](spark, FOLDER)
    cursor = sql.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert compare(frame.columns, frame.collect(), columns, cursor.fetchall()) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    frame = entry.queries()[name](spark, FOLDER)
    assert frame.columns
    frame.collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
