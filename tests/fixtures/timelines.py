"""Timelines, captions and chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import text as T
from vellumspark.operators import timeline as TL
from vellumspark.plans.base import Book

BOOK = Book()


@BOOK.add("""SELECT * FROM (VALUES (1, '0:00:00.00', '00:00:00,000', '0:00'), (2, '1:02:05.50', '01:02:05,500', '1:02:05'), (3, '0:12:05.25', '00:12:05,250', '12:05')) AS t(id, ass, srt, clock)""")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIM-04, TXT-23: caption and chapter times."""
    rows = spark.sql("SELECT * FROM (VALUES (1, 0.0D, 100.0D), (2, 3725.5D, 4000.0D), (3, 725.25D, 900.0D)) AS t(id, s, total)")
    return rows.select("id", TL.ass_time(F.col("s")).alias("ass"), TL.srt_time(F.col("s")).alias("srt"), T.clock(F.col("s"), F.col("total")).alias("clock"))


@BOOK.add("""SELECT * FROM (VALUES (1, 1, 0.0e0, 'The paper'), (1, 2, 12.0e0, 'Roadmap'), (1, 3, 30.0e0, 'Methods'), (1, 4, 90.0e0, 'Results'), (2, 1, 0.0e0, 'A'), (2, 2, 20.0e0, 'Main'), (3, 1, 0.0e0, 'A')) AS t(video, pos, start, title)""")
def video_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-10: chapters of ten seconds or more, by a fold inside the JVM."""
    rows = spark.sql(
        """SELECT * FROM (VALUES (1, 0.0D, 'The paper', 0, 200.0D), (1, 12.0D, 'Roadmap', 0, 200.0D), (1, 30.0D, 'Methods', 0, 200.0D), (1, 36.0D, 'Data', 1, 200.0D), (1, 90.0D, 'Results', 0, 200.0D),
        (2, 0.0D, 'A', 0, 80.0D), (2, 20.0D, 'Main', 0, 80.0D), (2, 24.0D, 'Sub', 1, 80.0D), (2, 75.0D, 'End', 0, 80.0D), (3, 5.0D, 'A', 0, 9.0D)) AS t(video, start, title, level, total)"""
    )
    each = rows.groupBy("video", "total").agg(F.sort_array(F.collect_list(F.struct("start", "title", "level"))).alias("rows"))
    out = each.select("video", F.posexplode(TL.chapters(F.col("rows"), F.col("total"))).alias("pos", "c"))
    return out.select("video", (F.col("pos") + 1).alias("pos"), "c.start", "c.title")


