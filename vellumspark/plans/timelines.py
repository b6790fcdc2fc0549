"""Timelines, captions and chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as T
from vellumspark.operators import timeline as TL
from vellumspark.plans.base import Book, table

BOOK = Book()

#: Shape only: conversations have no chapters or clips, so roles stand for chapters and a word lasts 0.4 s.
_ROWS = r"SELECT conv_id, turn, role AS chapter, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) / 2.5e0 AS seconds, 0e0 AS pause FROM conversations"
_TIMELINE = f"""r AS ({_ROWS}), g AS (SELECT *, CASE WHEN lag(chapter) OVER w IS NULL THEN 0e0 WHEN lag(chapter) OVER w <> chapter THEN 0.85e0 ELSE 0.35e0 END AS gap,
 coalesce(sum(seconds + pause) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, 0.5e0 + spent + sum(gap) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS raw FROM g),
t AS (SELECT *, round_even(raw, 3) AS start, round_even(raw + seconds, 3) AS finish, round_even(max(raw + seconds + pause) OVER (PARTITION BY conv_id) + 2.5e0, 3) AS total FROM s),
l AS (SELECT *, CASE WHEN lag(start) OVER w IS NULL THEN 0e0 ELSE start - 0.15e0 END AS seg_from, coalesce(lead(start) OVER w - 0.15e0, total) AS seg_to FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    return talk.select("conv_id", "turn", F.col("role").alias("chapter"), "text", (T.word_count(F.col("text")) / 2.5).alias("seconds"), F.lit(0.0).alias("pause"))


@BOOK.add(f"WITH {_TIMELINE} SELECT conv_id, turn, start, finish, total, round_even(seg_from, 3) AS seg_from, round_even(seg_to, 3) AS seg_to FROM l")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01, WIN-02: starts, ends and segments of all turns of every conversation."""
    rows = TL.timeline(_rows(spark, sf_dir), "conv_id", "turn")
    return rows.select("conv_id", "turn", "start", "finish", "total", F.bround("seg_from", 3).alias("seg_from"), F.bround("seg_to", 3).alias("seg_to"))


@BOOK.add(f"WITH {_TIMELINE} SELECT conv_id, turn, CAST(round_even(start * 48000, 0) AS BIGINT) * 4 AS offset FROM l")
def sample_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIM-02, SNK-09: byte offsets of the clips in a stereo 16-bit track of 48 kHz."""
    rows = TL.timeline(_rows(spark, sf_dir), "conv_id", "turn")
    return rows.select("conv_id", "turn", TL.sample_offset(F.col("start"), 48000, 2, 2).alias("offset"))


@BOOK.add(f"""WITH {_TIMELINE}, f AS (SELECT *, lead(start) OVER (PARTITION BY conv_id ORDER BY turn) AS next_start FROM l),
c AS (SELECT conv_id, turn, start, finish, next_start, unnest(p) AS card, generate_subscripts(p, 1) AS k FROM (SELECT *, list_filter(string_split(regexp_replace(text, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM f)),
u AS (SELECT *, (finish - start) / sum(length(card)) OVER (PARTITION BY conv_id, turn) AS share, coalesce(sum(length(card)) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, lead(card) OVER (PARTITION BY conv_id, turn ORDER BY k) AS nxt FROM c),
v AS (SELECT conv_id, turn, k, CAST(round_even((start + share * done) * 1000, 0) AS BIGINT) AS a, CAST(round_even((CASE WHEN nxt IS NULL THEN least(finish + 0.4e0, coalesce(next_start, finish + 1) - 0.05e0) ELSE start + share * done + share * length(card) END) * 1000, 0) AS BIGINT) AS b FROM u)
SELECT conv_id, turn, CAST(k - 1 AS INTEGER) AS card, printf('%02d:%02d:%02d,%03d', CAST(floor(a / 3600000) AS BIGINT), CAST(floor(a / 60000) AS BIGINT) % 60, CAST(floor(a / 1000) AS BIGINT) % 60, a % 1000) AS t0, printf('%02d:%02d:%02d,%03d', CAST(floor(b / 3600000) AS BIGINT), CAST(floor(b / 60000) AS BIGINT) % 60, CAST(floor(b / 1000) AS BIGINT) % 60, b % 1000) AS t1 FROM v""")
def srt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIM-03, TIM-04, SNK-03: cue times, a turn's time shared by the characters of its sentences."""
    rows = TL.timeline(_rows(spark, sf_dir), "conv_id", "turn")
    rows = rows.withColumn("next_start", F.lead("start").over(Window.partitionBy("conv_id").orderBy("turn")))
    cards = rows.select("conv_id", "turn", "start", "finish", "next_start", F.posexplode(T.sentences(F.col("text"))).alias("card", "text"))
    timed = TL.cues(cards, "conv_id", "turn", "card")
    return timed.select("conv_id", "turn", "card", TL.srt_time(F.col("t0")).alias("t0"), TL.srt_time(F.col("t1")).alias("t1"))


@BOOK.add()
def caption_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-14: the caption cards of every turn, in order. A fold over words, which SQL has no plain form for; tests hold it
    against a plain version."""
    talk = table(spark, sf_dir, "conversations")
    return talk.select("conv_id", "turn", F.posexplode(TL.hard_cards(F.col("text"))).alias("card", "text"))


@BOOK.add(r"""SELECT format('c{:02d}_s{:03d}', conv_id, turn) AS id, conv_id, turn, text FROM conversations""")
def sentence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-03: flattened scripts with identifiers of chapter and sentence; nested in, flat out."""
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("s"))
    flat = nested.select("conv_id", F.explode("s").alias("s")).select("conv_id", "s.turn", "s.text")
    return flat.select(F.format_string("c%02d_s%03d", "conv_id", "turn").alias("id"), "conv_id", "turn", "text")
