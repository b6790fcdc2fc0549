"""Metrics of scripts and documents: readability, repetition, coverage, comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumspark.operators import metrics as M
from vellumspark.plans.base import Book

BOOK = Book()


@BOOK.add("""SELECT * FROM (VALUES (1, 2, 3, 0.667e0), (2, 1, 1, 1.0e0), (3, 0, 0, 0.0e0)) AS t(id, covered, wanted, coverage)""")
def abstract_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-06, SET-03, SET-04: the share of an abstract's numbers that a script states."""
    rows = spark.sql(
        r"""SELECT * FROM (VALUES (1, 'Title\nAbstract We solve 40% of 2,294 tasks in 2.5 hours.\n1 Introduction\nAnd 77 more.', 'About 40% of 2,294.'),
        (2, 'No heading, 12 items', '12 items'), (3, 'Abstract\nnothing', 'nothing')) AS t(id, paper, script)"""
    )
    return M.abstract_coverage(rows, "paper", "script").drop("paper", "script")
