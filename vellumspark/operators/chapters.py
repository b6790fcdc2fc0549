"""Outlines as a whole: the chapters of a script, from the opening over a paper's sections to the takeaway.

Sections are rows (paper, order, title, parent, appendix, and a weight or words). A title begins with its number; number 0
is front matter, which feeds the opening. A paper without a section of its own in the body keeps opening and closing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.operators import outline as O
from vellumspark.operators.sections import short_title

OPENING = (("paper", "The paper"), ("hook", "Intro"))
CLOSING = (("limits", "Limitations"), ("takeaway", "Takeaway"))


def unnumbered(title: Column) -> Column:
    return F.regexp_replace(title, r"^\S+\s+", "")


def number(title: Column) -> Column:
    return F.regexp_extract(title, r"^\s*(\S+)", 1)


def group_title(bases: Column) -> Column:
    """A main section's name stands before those of its parts; equals are joined by ``&``."""
    names = F.transform(bases, unnumbered)
    rest = F.array_join(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(1))), " & ")
    led = (F.size(names) > 1) & ~number(bases[0]).contains(".")
    return short_title(F.when(led, F.concat(names[0], F.lit(": "), rest)).otherwise(F.array_join(names, " & ")))


def _framed(body: DataFrame, papers: DataFrame, paper: str, sizes: dict[str, Column]) -> DataFrame:
    """(paper, place, key, title, n): ``body`` (g, key, title, n) between the opening and the closing of each paper.

    ``sizes`` gives sentences by key, over the columns of ``papers``; a chapter of none is left out."""
    ends = [(k, key, title) for k, (key, title) in zip((-2, -1), OPENING)] + [(k, key, title) for k, (key, title) in zip((2**30, 2**30 + 1), CLOSING)]
    rows = F.array(*(F.struct(F.lit(k).cast("long").alias("g"), F.lit(key).alias("key"), F.lit(title).alias("title"), sizes[key].cast("int").alias("n")) for k, key, title in ends))
    frame = papers.select(paper, F.inline(rows)).where("n > 0")
    both = frame.unionByName(body.select(paper, F.col("g").cast("long").alias("g"), "key", "title", "n"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(paper).orderBy("g"))).select(paper, "place", "key", "title", "n")


def _front(title: Column) -> Column:
    return title.startswith("0 ")


def summary(sections: DataFrame, paper: str, order: str, minutes: Column, weight: str) -> DataFrame:
    """The outline for a length in minutes: neighbours of one main section make a chapter, the sentences are shared by weight."""
    names = F.concat_ws(" ", "title", "parent")
    body = sections.where(~F.col("appendix") & ~names.rlike(O.SKIP) & ~_front(F.col("title")) & ~O.is_limitation(F.col("title")))
    window = Window.partitionBy(paper).orderBy(order)
    marked = body.withColumn("top", F.substring_index(number(F.col("title")), ".", 1)).withColumn("before", F.lag("top").over(window))
    placed = marked.withColumn("g", F.sum(F.when(F.col("before").eqNullSafe(F.col("top")), 0).otherwise(1)).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    shown = F.when(F.coalesce("parent", F.lit("")) != "", F.col("parent")).otherwise(unnumbered(F.col("title")))
    groups = placed.groupBy(paper, "g").agg(F.min("top").alias("top"), F.min_by(shown, F.col(order)).alias("title"), F.greatest(F.sum(weight), F.lit(1)).alias("w"))
    chapters = O.share_budget(groups, paper, minutes, "w").select(paper, "g", F.concat(F.lit("s"), "top").alias("key"), short_title(F.col("title")).alias("title"), "n")
    total = F.greatest(F.lit(12), F.bround(minutes * O.WORDS_PER_MINUTE / O.WORDS_PER_SENTENCE))
    sizes = {key: F.greatest(F.lit(2), F.bround(total * share)) for key, share in (("paper", 0.08), ("hook", 0.1), ("limits", 0.1), ("takeaway", 0.07))}
    return _framed(chapters, sections.select(paper).distinct(), paper, sizes)


def whole(sections: DataFrame, paper: str, order: str) -> DataFrame:
    """The outline of a whole paper: every section, the appendix in brief; limitations apart only where no section has them.

    A task folds the sections of one paper at a time."""
    names = F.concat_ws(" ", "title", "parent")
    base = F.regexp_replace("title", r"\s*\(part \d+\)$", "")
    inside = ~names.rlike(O.SKIP_WHOLE) & ~_front(F.col("title"))
    row = F.struct(F.col(order).alias("at"), base.alias("base"), "parent", "appendix", F.col("words").cast("long").alias("words"))
    held = sections.groupBy(paper).agg(F.array_sort(F.collect_list(F.when(inside, row))).alias("s"))
    grouped = held.select(paper, O.group_sections(F.col("s")).alias("groups"))
    words, bases = F.col("c.words"), F.col("c.bases")
    brief = F.greatest(F.lit(1), F.least(F.lit(4), F.bround(words / 160)))
    full = F.greatest(F.lit(2), F.least(F.lit(16), F.bround(words / 55)))
    chapters = grouped.select(paper, F.posexplode("groups").alias("g", "c")).select(
        paper, "g", F.concat(F.lit("s"), number(bases[0])).alias("key"), group_title(bases).alias("title"), F.when(F.col("c.appendix"), brief).otherwise(full).cast("int").alias("n")
    )
    limited = F.exists("groups", lambda c: F.exists(c["bases"], O.is_limitation))
    sizes = {key: F.lit(4) for key in ("paper", "hook", "takeaway")} | {"limits": F.when(limited, 0).otherwise(4)}
    return _framed(chapters, grouped, paper, sizes)
