import pytest

from tests.oracle import connect, differences
from tracework import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert differences(catalogue.queries()[name](spark, SF), connect(SF), catalogue.oracle_sql()[name]) == []
