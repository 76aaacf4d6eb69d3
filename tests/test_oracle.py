"""Every registered query runs at the smallest scale; those with SQL must give DuckDB's rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import connect, differences

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = queries()[name](spark, ROOT).toPandas()
    assert differences(got, duck.execute(oracle_sql()[name]).df()) is None
