"""Every registered query against its checking SQL on the smallest tables."""

import os

import duckdb
import pytest

from suite import load
from suite.check import compare
from suite.registry import BASE_TABLES, REGISTRY

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

load()


@pytest.fixture(scope="module")
def connection():
    database = duckdb.connect()
    for table in BASE_TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return database


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not present")
@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_sql(spark, connection, name):
    text, _, good = compare(name, spark, FOLDER, connection)
    assert good, text


def test_entry_reports_the_run(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
