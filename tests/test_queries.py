"""Every query against its SQL."""

import pytest

import __spark_entry__ as entry
from gradus.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(check, name):
    check(catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "question_id" in df.columns


def test_each_query_is_registered():
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
