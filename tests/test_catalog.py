"""Every registered query against its SQL twin on the smallest test tables."""

import os

import pytest
from oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from tidelog.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert differences(queries()[name](spark, FOLDER), con, oracle_sql()[name]) == []


def test_entry(spark):
    assert entry(spark).columns == ["bucket_start", "group_value", "count"]
    assert set(ORACLES) == set(QUERIES)
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", ["search_text", "agg_1d", "store_aggregate", "visibility_lag", "validate_accepted"])
def test_session_zone_does_not_matter(new_york, con, name):
    assert differences(queries()[name](new_york, FOLDER), con, oracle_sql()[name]) == []
