"""Every registered query of the catalogue against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from tests import compare
from vellumspark.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(tables):
    return compare.connection(tables)


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == {"caption_cards", "whole_outline"}  # test_whole holds them against plain versions
    assert len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, duck, name):
    compare.same(QUERIES[name](spark, tables), duck, SQL[name])


def test_entry(spark, tables):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
