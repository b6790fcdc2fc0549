"""Timelines of narrated sentences: starts, segments, frames, captions, chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds before the first sentence, between sentences, between chapters, and at the end; frames a second.
LEAD, GAP, CHAPTER_GAP, TAIL, FPS = 0.5, 0.35, 0.85, 2.5, 30
#: Characters of a caption card and of one of its lines; cards shorter than this join a neighbour.
CARD, LINE, SHORT = 84, 46, 28
SHORTEST = 10.0


def timeline(rows: DataFrame, by: str, order: str) -> DataFrame:
    """rows (chapter, seconds, pause) with start, finish, total, seg_from, seg_to, frames. One window for each script."""
    w = Window.partitionBy(by).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.when(F.lag("chapter").over(w).isNull(), 0.0).when(F.lag("chapter").over(w) != F.col("chapter"), CHAPTER_GAP).otherwise(GAP)
    spent = F.coalesce(F.sum(F.col("seconds") + F.coalesce("pause", F.lit(0.0))).over(before), F.lit(0.0))
    timed = rows.withColumn("gap", gap).withColumn("spent", spent)
    start = F.lit(LEAD) + F.col("spent") + F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0))
    timed = timed.withColumn("raw", start)
    whole = Window.partitionBy(by)
    last = F.max(F.col("raw") + F.col("seconds") + F.coalesce("pause", F.lit(0.0))).over(whole) + TAIL
    timed = timed.withColumn("start", F.bround("raw", 3)).withColumn("finish", F.bround(F.col("raw") + F.col("seconds"), 3)).withColumn("total", F.bround(last, 3))
    a = F.when(F.lag("start").over(w).isNull(), 0.0).otherwise(F.col("start") - 0.15)
    b = F.coalesce(F.lead("start").over(w) - 0.15, F.col("total"))
    timed = timed.withColumn("seg_from", a).withColumn("seg_to", b)
    frames = (F.bround(F.col("seg_to") * FPS) - F.bround(F.col("seg_from") * FPS)).cast("long")
    return timed.withColumn("frames", frames).drop("gap", "spent", "raw")


def sample_offset(start: Column, rate: int, channels: int, width: int) -> Column:
    """Byte offset of a start in a track."""
    return F.bround(start * rate).cast("long") * channels * width


def cues(cards: DataFrame, by: str, sentence: str, order: str) -> DataFrame:
    """Cards (start, finish, next_start, text) with t0 and t1: a sentence's time is shared by characters; its last card
    stays up to 0.4 s longer, but ends 0.05 s before the next sentence."""
    w = Window.partitionBy(by, sentence).orderBy(order)
    whole = Window.partitionBy(by, sentence)
    n = F.length("text")
    share = (F.col("finish") - F.col("start")) / F.sum(n).over(whole)
    t0 = F.col("start") + share * F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = F.least(F.col("finish") + 0.4, F.coalesce("next_start", F.col("finish") + 1) - 0.05)
    t1 = F.when(F.lead("text").over(w).isNull(), end).otherwise(t0 + share * n)
    return cards.withColumn("t0", t0).withColumn("t1", t1)


def srt_time(seconds: Column) -> Column:
    ms = F.bround(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def ass_time(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.concat(F.format_string("%d:%02d:", F.floor(s / 3600), F.floor(s % 3600 / 60)), F.format_string("%05.2f", seconds - F.floor(seconds / 60) * 60))


def hard_cards(text: Column, most: int = CARD) -> Column:
    """Cards of ``most`` characters: cut behind . ? ! :, then filled comma by comma, then cut at the last blank."""
    parts = F.split(text, r"(?<=[.?!:])\s+")

    def fill(p: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def step(acc: Column, s: Column) -> Column:
            over = (acc["open"] != "") & (F.length(acc["open"]) + 1 + F.length(s) > most)
            return F.struct(
                F.when(over, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
                F.when(over | (acc["open"] == ""), s).otherwise(F.concat(acc["open"], F.lit(" "), s)).alias("open"),
            )

        return F.aggregate(F.split(p, r"(?<=,)\s+"), start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))

    def cut(p: Column) -> Column:
        """At the last blank before the limit, again and again; a text without one stays whole behind it."""
        start = F.struct(F.array().cast("array<string>").alias("done"), p.alias("rest"))

        def step(acc: Column, _: Column) -> Column:
            head = F.substring(acc["rest"], 1, most)
            at = F.length(head) - F.instr(F.reverse(head), " ")
            over = (F.length(acc["rest"]) > most) & (F.instr(head, " ") > 0)
            return F.struct(
                F.when(over, F.concat(acc["done"], F.array(F.substring(head, F.lit(1), at)))).otherwise(acc["done"]).alias("done"),
                F.when(over, F.substring(acc["rest"], at + 2, F.length(acc["rest"]))).otherwise(acc["rest"]).alias("rest"),
            )

        rounds = F.sequence(F.lit(0), (F.length(p) / 20).cast("int"))
        return F.aggregate(rounds, start, step, lambda acc: F.concat(acc["done"], F.array(acc["rest"])))

    filled = F.flatten(F.transform(parts, lambda p: fill(p)))
    return F.filter(F.flatten(F.transform(filled, lambda p: cut(p))), lambda c: c != "")


def chapters(rows: Column, total: Column, shortest: float = SHORTEST) -> Column:
    """Array of (start, title, level) of chapters in order, as a fold: one shorter than ``shortest`` is merged into the
    next (a main section lends its title to its first subsection), a short last one into the one before; the first
    starts at 0."""
    kind = "array<struct<start:double,title:string,level:int,short:boolean>>"

    def step(acc: Column, k: Column) -> Column:
        r, following = F.element_at(rows, k), F.try_element_at(rows, k + 1)
        last = F.try_element_at(acc, F.lit(-1))
        merge = F.coalesce(last["short"], F.lit(False))
        start = F.when(merge, last["start"]).otherwise(r["start"])
        keep_name = merge & (last["level"] < r["level"])
        end = F.coalesce(following["start"], total)
        new = F.struct(
            start.alias("start"), F.when(keep_name, last["title"]).otherwise(r["title"]).alias("title"), F.when(keep_name, last["level"]).otherwise(r["level"]).alias("level"),
            ((end - start < shortest) & following.isNotNull()).alias("short"),
        )
        head = F.slice(acc, 1, F.greatest(F.size(acc) - F.when(merge, 1).otherwise(0), F.lit(0)))
        return F.concat(head, F.array(new)).cast(kind)

    merged = F.aggregate(F.sequence(F.lit(1), F.size(rows)), F.array().cast(kind), step)
    tail = F.try_element_at(merged, F.lit(-1))
    kept = F.when((F.size(merged) > 1) & (tail["start"] != 0) & (total - tail["start"] < shortest), F.slice(merged, 1, F.size(merged) - 1)).otherwise(merged)
    return F.transform(kept, lambda c, i: F.struct(F.when(i == 0, 0.0).otherwise(c["start"]).alias("start"), c["title"].alias("title"), c["level"].alias("level")))
