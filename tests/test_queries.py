"""Every registered query of the library against DuckDB on the smallest tables."""

import pytest
from helpers import DATA, same_rows

from quern.code_queries import OWN, OWN_SQL, QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    same_rows(QUERIES[name](spark, str(DATA)), SQL[name])


@pytest.mark.parametrize("name", sorted(OWN))
def test_example_matches_its_rows(spark, name):
    same_rows(OWN[name](spark, str(DATA)), OWN_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
