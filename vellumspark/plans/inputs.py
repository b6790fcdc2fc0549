"""Sources, sinks and the streaming extension, on folders written for the query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.plans.base import Book, table
from vellumspark.streaming import status

BOOK = Book()


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names; a temporary one only where none is named."""
    import tempfile

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = known.get() if known.isDefined() else f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/vellumspark-plans/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@BOOK.add("""SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the event table as a stream, rolled up by day with a watermark of an hour, appended to Parquet. A second
    arrival brings late copies of old events, which the watermark drops, and a mark that closes the last day."""
    path, events = _folder(spark), table(spark, sf_dir, "events")

    def arrive(rows: DataFrame) -> None:
        rows.repartition(2).write.mode("append").parquet(f"{path}/in")
        rolled = status.rolled_up(status.read_events(spark, f"{path}/in"), "1 hour")
        flat = rolled.select("event_type", F.col("window.start").cast("date").alias("day"), "n", "total")
        out = flat.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        out.trigger(availableNow=True).start().awaitTermination()

    last = F.lit(events.agg(F.max("ts")).first()[0])
    mark = events.limit(1).withColumn("event_type", F.lit("end"))
    arrive(events)
    late = events.where((F.col("event_id") % 10 == 0) & (F.col("ts") < last - F.expr("INTERVAL 3 DAYS")))
    arrive(late.unionByName(mark.withColumn("ts", last + F.expr("INTERVAL 10 DAYS"))))
    arrive(mark.withColumn("ts", last + F.expr("INTERVAL 20 DAYS")))
    return spark.read.schema("event_type string, day date, n long, total double").parquet(f"{path}/out").where("event_type <> 'end'").select("event_type", "day", "n", F.round("total", 6).alias("total"))


@BOOK.add("""SELECT lang, source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY CUBE (lang, source)""")
def library_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: documents and characters by every combination of language and source."""
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
