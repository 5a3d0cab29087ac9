"""Every registered query with SQL equals it on the smallest tables."""

import pytest

from lodestar import queries
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    same(spark, con, SF, queries.queries()[name], queries.oracle_sql()[name])
