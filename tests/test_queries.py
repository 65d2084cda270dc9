import pytest

from tests.oracle import agree
from webloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, name):
    agree(spark, sf, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_without_subpackage_names():
    import __spark_entry__ as e

    assert registry.FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())
