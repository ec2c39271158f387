"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as registered
import oracle
from kreiswerk.plans.catalog import QUERIES as RUNS
from kreiswerk.plans.catalog import SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query_equals_sql(spark, con, name):
    _, difference = oracle.compare(spark, con, RUNS[name], SQL[name], SF)
    assert difference is None, difference


def test_every_query_has_sql():
    assert set(RUNS) == set(SQL)
    assert set(RUNS) <= set(registered.queries()) and set(SQL) <= set(registered.oracle_sql())


def test_entry(spark):
    assert registered.entry(spark).count() > 0
