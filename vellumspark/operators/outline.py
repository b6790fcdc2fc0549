"""Content planning: which sections are needed, their roles, groups, and sentence budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as T

# Title words that leave a section out, and those that give its role.
SKIP = r"(?i)acknowledg|ethic|reproducib|author contribution|funding|impact statement|related work|background and related|references"
SKIP_WHOLE = r"(?i)acknowledg|ethic|reproducib|author contribution|funding|impact statement|societal|references"
NOT_CORE = r"(?i)introduc|related work|background|preliminar|motivat|conclu|acknowledg|ethic|reproducib|author contribution|funding|impact statement|societal|references"
LIMITATION = r"(?i)limitation|threat|validity|discussion|future work|caveat"
DISCUSSION = r"(?i)discuss|implication|threat|validity|limitation|lesson|insight|future work"
RESULTS = r"(?i)result|evaluat|experiments\b|finding|analys|ablation|performance|comparison|\brq\s*\d|research question|case stud|user stud"
SETUP = r"(?i)metric|setup|setting|baseline|protocol|dataset|implementation detail"
WORDS_PER_MINUTE, WORDS_PER_SENTENCE = 130, 20


def needed(depth: Column, title: Column, parent: Column, appendix: Column) -> Column:
    """Whether a kind of reading uses a section; sentence-by-sentence kinds need no notes at all."""
    names = F.concat_ws(" ", title, parent)
    skipped = F.when(depth == "full", names.rlike(SKIP_WHOLE)).otherwise(names.rlike(SKIP))
    return ~depth.isin("read", "deep") & (depth.isin("full", "pass3") | ~appendix) & ~skipped


def is_limitation(title: Column) -> Column:
    return title.rlike(LIMITATION)


def own_role(names: Column, parent: Column) -> Column:
    """Role from the titles of a section and its parent; null where they tell none."""
    discussion = F.exists(names, lambda n: n.rlike(DISCUSSION)) | parent.rlike(DISCUSSION)
    by_name = F.exists(names, lambda n: n.rlike(RESULTS) & ~n.rlike(SETUP))
    by_parent = parent.rlike(RESULTS) & ~parent.rlike(SETUP) & ~F.forall(names, lambda n: n.rlike(SETUP))
    return F.when(discussion, "Discussion").when(by_name | by_parent, "Results")


def roles(groups: DataFrame, by: str, order: str) -> DataFrame:
    """Groups (names, parent) with ``role``: a section that tells none is method before the first results, results after."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = groups.withColumn("own", own_role(F.col("names"), F.col("parent")))
    seen = F.coalesce(F.max(F.when(F.col("own") == "Results", 1).otherwise(0)).over(before), F.lit(0))
    return own.withColumn("role", F.coalesce("own", F.when(seen == 1, "Results").otherwise("Method"))).drop("own")


def content_budget(notes: DataFrame, by: str, least: int = 2, most: int = 18) -> DataFrame:
    """(by, n): sentences that a section needs. Distinct numbers and half the distinct points count with diminishing
    returns; each figure, up to five, adds one. Notes are rows (by, kind, value) of kinds number, point, figure."""
    distinct = lambda kind, v: F.count_distinct(F.when(F.col("kind") == kind, v))
    sums = notes.groupBy(by).agg(
        distinct("number", F.col("value")).alias("numbers"), distinct("point", F.col("value")).alias("points"), distinct("figure", T.figure_label(F.col("value"))).alias("figures")
    )
    units = F.col("numbers") + F.col("points") / 2
    n = F.bround(F.sqrt(units) * 1.5) + F.least("figures", F.lit(5))
    return sums.select(by, F.least(F.lit(most), F.greatest(F.lit(least), n)).cast("int").alias("n"))


def share_budget(groups: DataFrame, by: str, minutes: Column, weight: str) -> DataFrame:
    """(.., n): a length in minutes as sentences, fixed shares taken off, the rest split by weight, 1 to 25 each."""
    total = F.greatest(F.lit(12), F.bround(minutes * WORDS_PER_MINUTE / WORDS_PER_SENTENCE))
    fixed = sum((F.greatest(F.lit(2), F.bround(total * s)) for s in (0.08, 0.1, 0.07)), F.greatest(F.lit(2), F.bround(total * 0.1)))
    whole = Window.partitionBy(by)
    left = F.greatest(F.count("*").over(whole), total - fixed)
    n = F.bround(left * F.col(weight) / F.sum(weight).over(whole))
    return groups.withColumn("n", F.greatest(F.lit(1), F.least(F.lit(25), n)).cast("int"))


def top_groups(chapters: DataFrame, by: str, order: str) -> DataFrame:
    """(.., g): chapters of one main section share a number; a chapter without a dot in its own number begins a group."""
    window = Window.partitionBy(by).orderBy(order)
    top = F.when(F.coalesce("num", F.lit("")) != "", F.substring_index("num", ".", 1)).otherwise(F.col("key"))
    marked = chapters.withColumn("top", top)
    new = F.lag("top").over(window).isNull() | (F.lag("top").over(window) != F.col("top")) | ~F.coalesce("num", F.lit("")).contains(".")
    return marked.withColumn("new", new.cast("int")).withColumn("g", F.sum("new").over(window.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new", "top")


def group_sections(sections: Column, small: int = 150, most: int = 2400) -> Column:
    """Array of groups (bases, parent, appendix, words) of sections (base, parent, appendix, words) in order, as a fold:
    parts of one section, and sections behind a tiny one of the same parent, join while the group stays below ``most``."""
    kind = "array<struct<bases:array<string>,parent:string,appendix:boolean,words:bigint>>"
    empty = F.array().cast(kind)

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        known = F.array_contains(last["bases"], s["base"])
        joins = (
            (F.size(acc) > 0)
            & (last["appendix"] == s["appendix"])
            & (last["words"] + s["words"] < most)
            & (known | (last["parent"].eqNullSafe(s["parent"]) & (last["words"] < small)))
        )
        wider = F.struct(
            F.when(known, last["bases"]).otherwise(F.concat(last["bases"], F.array(s["base"]))).alias("bases"), last["parent"].alias("parent"), last["appendix"].alias("appendix"), (last["words"] + s["words"]).alias("words")
        )
        fresh = F.struct(F.array(s["base"]).alias("bases"), s["parent"].alias("parent"), s["appendix"].alias("appendix"), s["words"].alias("words"))
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(head, F.array(wider))).otherwise(F.concat(acc, F.array(fresh))).cast(kind)

    return F.aggregate(sections, empty, step)


def study_segments(groups: Column, most: int = 10) -> Column:
    """Array of (role, n, parts): neighbours of one role join while they have ``most`` sentences together."""
    kind = "array<struct<role:string,n:int,parts:int>>"

    def step(acc: Column, g: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce((last["role"] == g["role"]) & (last["n"] + g["n"] <= most), F.lit(False))
        wider = F.struct(last["role"].alias("role"), (last["n"] + g["n"]).alias("n"), (last["parts"] + 1).alias("parts"))
        fresh = F.struct(g["role"].alias("role"), g["n"].alias("n"), F.lit(1).alias("parts"))
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(wider))).otherwise(F.concat(acc, F.array(fresh))).cast(kind)

    return F.aggregate(groups, F.array().cast(kind), step)


def fit_length(sizes: Column, budget: Column, free: Column | None = None) -> Column:
    """How many sentences each chapter keeps: sizes is an array of word counts, an array for each chapter. The longest
    chapter (the first of equals) loses its last sentence until the words fit; a chapter keeps one at least. Only chapters
    marked in ``free`` (section chapters; by default all) are cut: openings and endings stay whole."""
    may = F.transform(sizes, lambda c: F.lit(True)) if free is None else free
    counts = F.transform(sizes, lambda c: F.size(c))
    total = F.aggregate(F.flatten(sizes), F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(counts.alias("kept"), total.alias("words"))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.flatten(sizes))))

    def step(acc: Column, _: Column) -> Column:
        cuttable = F.zip_with(acc["kept"], may, lambda n, ok: F.when(ok, n).otherwise(0))
        top = F.array_max(cuttable)
        at = F.array_position(cuttable, top).cast("int")
        over = (acc["words"] > budget) & (top > 1)
        fewer = F.transform(acc["kept"], lambda n, k: F.when(k == at - 1, n - 1).otherwise(n))
        return F.struct(
            F.when(over, fewer).otherwise(acc["kept"]).alias("kept"),
            F.when(over, acc["words"] - F.element_at(F.element_at(sizes, at), top)).otherwise(acc["words"]).alias("words"),
        )

    return F.aggregate(rounds, start, step, lambda acc: acc["kept"])


def alternate(rows: DataFrame, by: str, kind: str, order: str, first: str, most: int) -> DataFrame:
    """Rows of two kinds in turn, ``first`` leading, while both last; ``most`` in each group."""
    each = rows.withColumn("rn", F.row_number().over(Window.partitionBy(by, kind).orderBy(order)))
    turn = Window.partitionBy(by).orderBy("rn", F.when(F.col(kind) == first, 0).otherwise(1))
    return each.withColumn("place", F.row_number().over(turn)).where(F.col("place") <= most).drop("rn")
