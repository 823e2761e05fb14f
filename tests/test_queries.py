"""Every registered query against its SQL twin."""

import pytest
from oracle import connect, of_spark, of_sql

from complyspark.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = of_spark(registry.QUERIES[name](spark, sf_dir))
    if name in registry.SQL:
        assert got == of_sql(duck, registry.SQL[name])
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
