"""Sinks: atomic tables, JSON lines, captions, reports, side files. Each writes through Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.operators import timeline


def replace_table(df: DataFrame, path: str) -> None:
    """Spark's committer makes the new files visible only when all are written."""
    df.write.mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def json_documents(df: DataFrame, path: str, key: str) -> None:
    """One folder of JSON lines for each key."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def text_files(df: DataFrame, path: str, key: str) -> None:
    """(key, text): one folder for each key, its texts in it."""
    df.select(key, F.col("text").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def subtitles(cues: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(by, text): numbered cues (t0, t1, text) of each video as an SRT file's text."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    block = F.concat(n.cast("string"), F.lit("\n"), timeline.srt_time(F.col("t0")), F.lit(" --> "), timeline.srt_time(F.col("t1")), F.lit("\n"), "text", F.lit("\n"))
    blocks = cues.select(by, n.alias("n"), block.alias("b"))
    return blocks.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "b"))), lambda x: x["b"]), "\n").alias("text"))


def undisturbed(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(stem, extension, name): names that overwrite nobody else's file: ``Paper (2).mp4`` and on where it is taken."""
    stem = F.regexp_extract("name", r"^(.*?)(?: \((\d+)\))?(\.[^.]*)?$", 1)
    n = F.coalesce(F.regexp_extract("name", r"^(.*?)(?: \((\d+)\))?(\.[^.]*)?$", 2).try_cast("int"), F.lit(1))
    ext = F.regexp_extract("name", r"^(.*?)(?: \((\d+)\))?(\.[^.]*)?$", 3)
    used = taken.select(stem.alias("stem"), ext.alias("extension"), n.alias("n")).groupBy("stem", "extension").agg(F.collect_set("n").alias("used"))
    joined = wanted.join(used, ["stem", "extension"], "left")
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.coalesce(F.size("used"), F.lit(0)) + 1), F.coalesce("used", F.array().cast("array<int>"))))
    free = F.when(F.col("used").isNull(), 1).otherwise(free)
    return joined.select("stem", "extension", F.concat("stem", F.when(free > 1, F.concat(F.lit(" ("), free.cast("string"), F.lit(")"))).otherwise(""), "extension").alias("name"))
