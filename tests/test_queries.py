"""Every query with SQL gives the rows of its SQL."""

import pytest

from skeinflow import catalog

from .conftest import SF
from .oracle import connect, same


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_rows(spark, con, name):
    same(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["session", "event_id", "question", "answer"]
    assert entry.entry(spark).count() == 95
