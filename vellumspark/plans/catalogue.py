"""The registered queries and their SQL."""

from __future__ import annotations

import importlib

from vellumspark.plans.base import Query

MODULES = ("pages", "drafts", "lists", "verification", "metrics", "licensing", "segments", "timelines", "collections", "matching", "layouts", "scripts", "inputs")


def _books() -> list:
    return [importlib.import_module(f"vellumspark.plans.{m}").BOOK for m in MODULES]


def queries() -> dict[str, Query]:
    return {name: query for book in _books() for name, query in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in _books() for name, sql in book.sql.items()}
