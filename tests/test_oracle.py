"""Every registered query against its SQL, over whole tables."""

import os

import pytest

import __spark_entry__ as contract
from flowspark.checks import oracle, registry
from tests.compare import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    result = QUERIES[name](spark, SF_DIR).toArrow()
    assert result.num_rows > 0
    assert compare(result, con.sql(SQL[name]).to_arrow_table()) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
