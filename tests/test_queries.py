"""Every registered query against its SQL, over the whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from oracle import connect, differences
from queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLE[name]) == ""


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["account", "label", "nation", "origin"]
    assert df.count() > 0
