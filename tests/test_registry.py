import duckdb
import pytest

import __spark_entry__ as entry
import check
from outagelens.registry import load

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    database = duckdb.connect()
    for table in check.TABLES:
        database.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return database


@pytest.mark.parametrize("name", sorted(load()))
def test_query_agrees_with_its_sql(spark, connection, name):
    outcome = check.compare(spark, connection, name, FOLDER)
    assert not outcome.startswith("FAIL"), outcome


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "ZONE"


def test_every_query_has_its_sql():
    own = set(load())
    assert own <= set(entry.queries()) and own <= set(entry.oracle_sql())
