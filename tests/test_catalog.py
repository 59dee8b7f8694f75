import pytest

from memlattice.plans import queries

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, con, name):
    same(queries.QUERIES[name](spark, sf), con, queries.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 56
