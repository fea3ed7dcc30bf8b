"""Every core query with SQL equals it; the others run and have rows."""

import pytest

from provq.plans import catalog
from tests_data import DATA

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, same_rows, name):
    same_rows(catalog.queries()[name](spark, DATA), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
