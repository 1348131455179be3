import pytest

from quiltra.plans import catalog

from .oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, name):
    assert_same(spark, catalog.QUERIES[name], catalog.SQL[name])
