import pytest

from opinaria.plans import catalog
from tests.oracle import same

SF = "/root/testdata/sf0.001"
Q, S = catalog.queries(), catalog.oracle_sql()


def test_each_query_has_sql():
    assert Q.keys() == S.keys()


@pytest.mark.parametrize("name", Q)
def test_against_sql(spark, name):
    assert same(Q[name](spark, SF), S[name], SF) > 0
