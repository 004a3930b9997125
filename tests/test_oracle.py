"""Every registered query against its SQL, values compared exactly."""

from __future__ import annotations

import os

import oracle
import pytest

from registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("query", list(QUERIES))
def test_same_rows(spark, con, query):
    ours = oracle.spark_rows(QUERIES[query](spark, SF_DIR))
    theirs = oracle.duck_rows(con, ORACLES[query])
    assert ours[0] == theirs[0]
    assert len(ours[1]) > 0
    assert ours[1] == theirs[1]


def test_entry(spark):
    import __spark_entry__ as driver

    expected = oracle.duck_rows(oracle.connect("/root/testdata/sf0.001"), ORACLES["subgroup_rates"])
    assert driver.entry(spark).count() == len(expected[1])
    assert set(QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())
