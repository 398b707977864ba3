"""Every registered query against its SQL."""

import os

import pytest

from lodestone.plans import ORACLES, PLANS
from tests.compare import compare, connect

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
ROWS_ONLY = {"embedding_health_approx", "table_bytes"}
# Every document of the smallest tables has a vector.
MAY_BE_EMPTY = {"missing_keys"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(PLANS))
def test_query(spark, con, name):
    allowed = {"", "no rows on either side"} if name in MAY_BE_EMPTY else {""}
    assert compare(spark, con, FOLDER, name) in allowed


def test_all_but_the_approximate_have_sql():
    assert set(PLANS) - set(ORACLES) == ROWS_ONLY


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["c_custkey", "c_name", "total_amount"]
    assert df.count() == 10
