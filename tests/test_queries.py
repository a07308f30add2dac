"""Every registered query of the engine against the same in SQL."""

import pytest

from octavo.plans import queries as engine
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_matches_sql(spark, sf, con, name):
    assert difference(engine.QUERIES[name](spark, sf), con, engine.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_has_rows(spark, sf, name):
    assert engine.QUERIES[name](spark, sf).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
