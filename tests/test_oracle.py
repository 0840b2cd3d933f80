"""Every registered query against its SQL counterpart, value by value."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from punctual.catalogue import oracles
from punctual.catalogue import queries as catalogue

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = catalogue.queries()
ORACLES = oracles.oracle_sql()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    result = QUERIES[name](spark, FOLDER)
    columns, rows = _rows(result.columns, [tuple(r) for r in result.collect()])
    cursor = connection.execute(ORACLES[name])
    expected_columns, expected = _rows([d[0] for d in cursor.description], cursor.fetchall())
    assert columns == expected_columns
    assert len(rows) == len(expected)
    for got, want in zip(rows, expected):
        assert got == want
        assert [type(v) for v in got] == [type(v) for v in want]


def test_entry(spark):
    assert entry_point.entry(spark).count() == 2
