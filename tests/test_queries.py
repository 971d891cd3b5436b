"""Every registered query with an SQL counterpart agrees with it on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.verify import compare
from conftest import SMALL

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, database, name):
    assert compare(queries()[name](spark, SMALL), database, SQL[name]) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())


def test_flagship_query(spark):
    df = entry(spark)
    assert df.columns == ["plot_id", "species", "value"]
    assert df.count() > 0
