"""Every registered query against its SQL on the smallest test tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", entry.SMOKE_DIR)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(plain(row[i]) for i in order) for row in data]
    return sorted(picked, key=lambda row: tuple(str(v) for v in row))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, sql, name):
    result = entry.queries()[name](spark, SF_DIR)
    expected = sql.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(result.columns)
    got = rows(result.columns, [tuple(r) for r in result.collect()])
    assert got == rows(columns, expected.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_returns_rows(spark, name):
    assert entry.queries()[name](spark, SF_DIR).head(1)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
