"""Every query against its SQL check on the smallest tables."""

import pytest
from compare import compare, connect

from driftline.plans.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    _, difference = compare(df, con, ORACLE[name])
    assert difference == ""


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLE)
