"""Every registered query with a SQL counterpart gives the same rows, names and types."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    rows, _, problems = differences(QUERIES[name](spark, sf), con, ORACLES[name])
    assert not problems


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "n", "accuracy", "precision", "recall", "f1"]
