import pytest

import __spark_entry__ as entry
from tallygrove.plans import catalog


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.FLAGSHIP in entry.queries()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(name, spark, data):
    assert catalog.QUERIES[name](spark, data).count() > 0
