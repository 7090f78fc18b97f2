"""Every registered query against its SQL on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from logloom.suite import ORACLES, QUERIES
from tests.oracle import connect, mismatch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["source", "total_count", "error_count", "last_log"] and frame.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert mismatch(spark, con, SF, QUERIES[name], ORACLES[name]) in ("", "EMPTY")
