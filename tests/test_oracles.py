"""Every SQL-checkable query against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from compare import connect, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert difference(entry_module.queries()[name](spark, SF), con, ORACLES[name]) is None


def test_entry_gives_issues(spark):
    rows = entry_module.entry(spark).collect()
    assert any(r["rule_id"] == "HIGH_CARDINALITY" for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_module.queries())
