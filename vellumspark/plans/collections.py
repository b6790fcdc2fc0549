"""Libraries and playlists: ordering, numbering, states, reuse, titles, tags, quizzes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators import library as L
from vellumspark.plans.base import Book, table

BOOK = Book()


@BOOK.add("""WITH o AS (SELECT o_orderstatus AS list, o_orderkey AS item, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS published, o_orderpriority AS title FROM orders)
SELECT list, item, CAST(row_number() OVER (PARTITION BY list ORDER BY CASE WHEN published <> '' THEN 0 ELSE 1 END, nullif(published, '') NULLS FIRST, CASE WHEN published <> '' THEN title END NULLS FIRST, item) AS INTEGER) AS place FROM o""")
def playlist_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-01 on the shape of orders: oldest first, undated last in their own order."""
    orders = table(spark, sf_dir, "orders")
    published = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    items = orders.select(
        F.col("o_orderstatus").alias("list"), F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("pos"), published.alias("published"), F.lit(None).cast("int").alias("year"), F.col("o_orderpriority").alias("title")
    )
    return L.ordered(items, "list", "paper_date").select("list", "item", "place")


@BOOK.add("""WITH e AS (SELECT user_id, event_type AS status, value FROM events) SELECT user_id, round_even(avg(CASE WHEN status IN ('click', 'view') THEN 1e0 ELSE least(value, 100) / 100 END), 4) AS progress, bool_and(status IN ('click', 'view')) AS finished FROM e GROUP BY user_id""")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15, AGG-16 on the shape of events: two types stand for finished stages, the value for progress."""
    events = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type").isin("click", "view"), "done").otherwise("running")
    return L.stage_progress(events.select("user_id", status.alias("status"), (F.least("value", F.lit(100.0)) / 100).alias("progress")), "user_id")


@BOOK.add("""SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL""")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14 on the shape of events: counts by state."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@BOOK.add("""SELECT doc_id, sha1('v1|notes|m|' || text) AS key, doc_id % 3 = 0 AS hit FROM documents""")
def memo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-14: prompts with and without a kept answer, by hash."""
    requests = table(spark, sf_dir, "documents").select("doc_id", F.lit("notes").alias("name"), F.lit("m").alias("model"), F.col("text").alias("prompt"))
    key = F.sha1(F.concat_ws("|", F.lit("v1"), "name", "model", "prompt").cast("binary"))
    cache = requests.where("doc_id % 3 = 0").select(key.alias("key"), F.lit("{}").alias("answer")).distinct()
    third = requests.where("doc_id % 3 = 0").select(key.alias("key")).distinct().withColumn("own", F.lit(True))
    answered, todo = L.memo(requests, cache.join(third, "key").select("key", "answer"))
    hit = answered.join(todo.select("doc_id", F.lit(True).alias("asked")), "doc_id", "left")
    return hit.select("doc_id", "key", (F.col("doc_id") % 3 == 0).alias("hit"))


