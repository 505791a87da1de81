"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from checks import oracle, spark_queries
from checks.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(spark_queries.QUERIES))
def test_query_agrees_with_sql(spark, sf, con, name):
    ok, note = compare(spark, con, sf, name)
    assert ok, note


def test_entry_runs(spark):
    assert not entry_points.entry(spark).isEmpty()


def test_every_query_has_sql():
    assert set(spark_queries.QUERIES) == set(oracle.oracle_sql())
