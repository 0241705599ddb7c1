import pytest

from tests.oracle import connection, same
from waystone.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SMALL), catalog.SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    catalog.QUERIES[name](spark, SMALL).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
