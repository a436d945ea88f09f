import pytest

from marlpit import registry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query_matches_its_sql(spark, connection, name):
    assert compare(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], connection) is None
