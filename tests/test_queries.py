"""Every registered query against its SQL counterpart, on whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry
from tests.conftest import SF_DIR

QUERIES = registry.queries()
SQL = registry.oracle_sql()
OWN = QUERIES.keys() - registry.LLM_QUERIES.keys()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in Path(SF_DIR).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return connection


def test_every_query_has_sql():
    assert OWN == SQL.keys() - registry.LLM_SQL.keys()


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is None, str(v)) for v in row))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12)
    return a == b and type(a) is type(b)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    expected = duck.sql(SQL[name])
    assert sorted(result.columns) == sorted(expected.columns)
    ours = sorted_rows(result.columns, [tuple(r) for r in result.collect()])
    theirs = sorted_rows(expected.columns, expected.fetchall())
    assert len(ours) == len(theirs) > 0
    for a, b in zip(ours, theirs):
        assert all(map(same, a, b)), (a, b)


def test_entry(spark):
    assert registry.entry(spark).count() == 30
