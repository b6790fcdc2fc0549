"""Extension: a status feed as a stream. The operators of this library that take one row at a time (numbers, licences,
identifiers, predicates) run on streams as they are; this module adds the roll-up of job events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """Parquet files of events that arrive under ``path``; the schema is taken from what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def rolled_up(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window, event_type, n, total): counts and sums by event time; events later than ``late`` are dropped, which bounds
    the state. Times without a zone are taken as the session's."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def verified(sentences: DataFrame, known: DataFrame) -> DataFrame:
    """Stream-static join: sentences (id, paper, text) of a stream with their numbers that the paper doesn't know."""
    from vellumspark.functions import text as T

    numbers = sentences.select("id", "paper", F.explode(T.stated_numbers(F.col("text"))).alias("raw"))
    stated = numbers.select("id", "paper", T.norm_number(F.col("raw")).alias("number"))
    return stated.join(known.withColumn("found", F.lit(True)), ["paper", "number"], "left").where("found IS NULL").drop("found")
