"""Queries of the package with an SQL counterpart agree with it."""

import pytest

from checks.verify import compare
from sward.llm.queries import ORACLES, QUERIES
from llm_cases import small  # noqa: F401


SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    assert compare(QUERIES[name](spark, SMALL), database, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_per_document(spark, small, name):
    assert QUERIES[name](spark, SMALL).count() == small.count()
