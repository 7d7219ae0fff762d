import pytest
from oracle_check import connect, difference

from crosslume.plans.oracle import ORACLE
from crosslume.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, name, SF) is None
