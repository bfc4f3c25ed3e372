"""Every registered query against its check SQL in DuckDB."""

import os

import duckdb
import pytest

from tablewright.plans import registry
from tablewright.plans.mapping import BASE_TABLES
from tests.oracle import compare

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, CHECKS = registry.load()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = compare(con, QUERIES[name](spark, FOLDER), CHECKS.get(name))
    assert result.startswith("ok"), result


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
