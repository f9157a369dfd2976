import pytest

from tessera.plans import registry
from tests.compare import difference


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, sf, name):
    assert difference(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_queries_without_sql_give_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
