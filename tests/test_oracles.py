from __future__ import annotations

import pytest

import __spark_entry__
from tessera.plans import catalogue
from tests.oracle import compare, connection


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(k for k, v in catalogue.ORACLES.items() if v))
def test_query_equals_its_sql(spark, sf, con, name):
    assert compare(con, catalogue.QUERIES[name](spark, sf), catalogue.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(k for k, v in catalogue.ORACLES.items() if not v))
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
