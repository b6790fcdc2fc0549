"""Operators on hand-made rows: every case of tests/fixtures against the rows written down beside it."""

from __future__ import annotations

import duckdb
import pytest

from tests import compare
from tests.fixtures import collections, inputs, layouts, licensing, matching, metrics, scripts, segments, timelines, verification

MODULES = (collections, inputs, layouts, licensing, matching, metrics, scripts, segments, timelines, verification)
CASES = {name: (query, module.BOOK.sql[name]) for module in MODULES for name, query in module.BOOK.queries.items()}


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    query, expected = CASES[name]
    compare.same(query(spark, "no tables are read"), duckdb.connect(), expected)
