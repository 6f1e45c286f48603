"""Every registered query against its check SQL on the smallest data."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
CHECKS = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", list(queries()))
def test_query_matches_its_check(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    if name in CHECKS:
        assert difference(df, duck, CHECKS[name]) is None
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry(spark).count() > 0
