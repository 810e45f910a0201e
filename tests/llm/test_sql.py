import pytest

from rillflow.llm.queries import QUERIES, SQL
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    here, there, wrong = differences(QUERIES[name](spark, SF), SQL[name], SF)
    assert here == there > 0 and not wrong
