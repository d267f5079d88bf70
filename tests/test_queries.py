"""Every query against its SQL, and every query without SQL to the end."""

import pytest

from conftest import DATA, same_as_sql
from tallyline.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    same_as_sql(spark, duck, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
