"""Every registered query with a statement equals DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check_oracles import compare, database


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


def test_statements_belong_to_queries_and_entry_is_stable(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).schema == entry.entry(spark).schema


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_statement(spark, con, sf, name):
    ok, note = compare(spark, con, name, sf)
    assert ok, note
