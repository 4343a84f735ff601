import pytest

from tests.oracle import connect, rows

D = "/root/testdata/sf0.001"


def names():
    from kgraph.plans.queries import SQL

    return sorted(SQL)


@pytest.fixture(scope="module")
def duck():
    return connect(D)


@pytest.mark.parametrize("name", names())
def test_against_sql(spark, duck, name):
    from kgraph.plans.queries import QUERIES, SQL

    got, want = QUERIES[name](spark, D).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
