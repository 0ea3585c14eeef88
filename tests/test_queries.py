"""Every query with SQL against that SQL; the others must give rows."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) in (None, EMPTY_BY_NATURE.get(name))


# A group without a row 1500 at this scale, and splits that may be empty.
EMPTY_BY_NATURE = {name: "no rows" for name in ("nth_event_per_type", "task_table_val", "task_table_test_masked")}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["user_id", "nth_time", "segment", "split"]
    assert df.count() > 0
