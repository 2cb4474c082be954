"""Every registered query against its SQL, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry

from paceline.suite.oracle import oracle_sql
from paceline.suite.queries import QUERIES

SQL = oracle_sql()


@pytest.fixture(scope="module")
def connection(sf):
    return compare.connection(sf)


def test_names_match():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, connection, name):
    assert compare.differences(QUERIES[name](spark, sf), connection, SQL[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
