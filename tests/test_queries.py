"""Every query of the core operators against the SQL registered beside it."""

import pytest

import __spark_entry__ as entry
from cratelog import queries as own


@pytest.mark.parametrize("name", list(own.queries()))
def test_query_equals_sql(spark, small, same_as_duckdb, name):
    same_as_duckdb(own.queries()[name](spark, small), own.oracle_sql()[name], small)


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["project_id", "progress", "message"]
    assert rows.count() == 25


def test_every_query_is_registered():
    assert set(own.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
