"""Every registered query against its SQL on the smallest tables."""

import pytest

from fathom.catalog import all_oracle_sql, all_queries
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_each_query_has_sql():
    assert set(all_queries()) == set(all_oracle_sql())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_same_as_sql(spark, con, name):
    left, right = compare(spark, con, all_queries()[name], all_oracle_sql()[name], SF)
    assert left == right
