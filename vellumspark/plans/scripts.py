"""Outlines, budgets, scripts and their side files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators import outline as O
from vellumspark.plans.base import Book, table

BOOK = Book()


@BOOK.add("""SELECT conv_id, turn, CAST(greatest(1, least(25, round_even(greatest(c, 65 - 22) * w / s, 0))) AS INTEGER) AS n FROM (SELECT conv_id, turn, length(text) AS w, count(*) OVER (PARTITION BY conv_id) AS c, sum(length(text)) OVER (PARTITION BY conv_id) AS s FROM conversations)""")
def shared_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13: ten minutes split over the parts of each conversation by their length."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("w"))
    return O.share_budget(rows, "conv_id", F.lit(10.0), "w").select("conv_id", "turn", "n")


