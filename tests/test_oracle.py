"""Every registered query against DuckDB on the given tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from dagtrail.plans import oracle, queries

FOLDER = os.environ.get("DAGTRAIL_TEST_DATA", "/root/testdata/sf0.01")
TABLES = [f[:-8] for f in sorted(os.listdir(FOLDER)) if f.endswith(".parquet")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    result = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    expected = cursor.fetchall()
    actual = [tuple(r) for r in result.collect()]
    assert actual, "an empty result proves nothing"
    assert _rows(result.columns, actual) == _rows(columns, expected)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
