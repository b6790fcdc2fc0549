"""Connected components of a link table by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import delete, stored

#: The rounds needed grow with the logarithm of the longest chain; this many would do for 2**40 nodes.
MOST_ROUNDS = 80


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node hangs its (larger, or else smaller-or-equal) neighbours on its smallest neighbour."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = around.join(least, "u")
    if large:
        hung = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        hung = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (columns a, b): root is the smallest node it can reach.

    Nodes without a link are not listed. Each round is written to the shared folder and the one before it is deleted.
    """
    spark = links.sparkSession
    edges, path = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(MOST_ROUNDS):
        after, to = stored(_star(_star(edges, True), False), "stars")
        state = tuple(after.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        delete(spark, path)
        edges, path = after, to
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
