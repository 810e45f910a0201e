"""Every query that has SQL against DuckDB, and the rest for rows."""

import pytest

from rillflow.plans import registry
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, name):
    here, there, wrong = differences(registry.QUERIES[name](spark, SF), registry.SQL[name], SF)
    assert here == there and not wrong, wrong
    assert here > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
