"""Sections of papers: headings among lines, splitting, numbers that only move forward, folding of repeated numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as T

# What a numbered heading looks like, what ends the body, what begins the appendix, little words of titles.
HEADING = r"^\s{0,60}((?:\d{1,2}|[A-H])(?:\.\d{1,2}){0,2})\.?\s{1,16}((?:[A-Z]|[^\x00-\x7F])[^\n]{2,90})$"
REFERENCES = r"^\s*(R\s?EFERENCES|References|REFERENCES|Bibliography)\s*$"
APPENDIX = r"^\s*A\s?PPENDIX|^\s*Appendix\s*$"
LITTLE = "a an and as at by for from in of on or the to via vs with".split()
LEAST_WORDS = 25


def heading(line: Column) -> tuple[Column, Column]:
    """(number, title) of a line that reads as a numbered heading; empty strings else: under 90 characters, no point at
    the end, a title of twelve words at most with three letters and no number of three digits."""
    number, title = F.regexp_extract(line, HEADING, 1), F.trim(F.regexp_replace(F.regexp_extract(line, HEADING, 2), r"\s+", " "))
    bare = F.trim(line)
    letters = F.length(F.regexp_replace(title, r"[^\p{L}]", ""))
    fits = (F.length(bare) < 90) & ~bare.endswith(".") & ~title.rlike(r"\d{3,}") & (letters >= 3) & (T.word_count(title) <= 12)
    return F.when(fits, number).otherwise(""), F.when(fits, title).otherwise("")


def marked(lines: DataFrame, doc: str, order: str, line: str = "line") -> DataFrame:
    """Lines with ``section``: the count of section starts so far, and the num, title, kind and appendix flag of a start.

    A number below one that came before is text of a figure, unless the appendix has begun. As a heading is taken exactly
    if none before it was larger, the largest number so far among all candidates decides: one window, no fold.
    """
    number, title = heading(F.col(line))
    upto = Window.partitionBy(doc).orderBy(order)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumns({"num": number, "title": title, "stops": F.trim(line).rlike(REFERENCES), "opens": F.trim(line).rlike(APPENDIX)})
    rows = rows.withColumn("late", F.coalesce(F.max("opens").over(upto.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    rows = rows.withColumn("top", F.when(F.col("num").rlike("^[0-9]") & ~F.col("stops"), F.substring_index("num", ".", 1).cast("int")))
    behind = F.coalesce(F.col("top") < F.max("top").over(before), F.lit(False)) & ~F.col("late")
    starts = F.col("stops") | ((F.col("num") != "") & ~behind)
    rows = rows.withColumn("starts", starts)
    return rows.withColumn("section", F.sum(F.col("starts").cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, 0)))


def split(lines: DataFrame, doc: str, order: str, line: str = "line", least: int = LEAST_WORDS) -> DataFrame:
    """(doc, section, num, title, parent, appendix, words, text): the numbered sections of each text, references left out,
    those of fewer than ``least`` words dropped. The parent is the title of the last section without a dot before it."""
    rows = marked(lines, doc, order, line)
    head = F.struct("num", "title", "stops", "late")
    piece = F.when(~F.col("starts"), F.struct(F.col(order).alias("o"), F.col(line).alias("t")))
    whole = rows.groupBy(doc, "section").agg(F.max_by(F.when(F.col("starts"), head), F.when(F.col("starts"), F.lit(1))).alias("h"), F.sort_array(F.collect_list(piece)).alias("x"))
    num = F.coalesce("h.num", F.lit("0"))
    title = F.coalesce("h.title", F.lit("Front matter"))
    letter = ~F.substring(num, 1, 1).between("0", "9")
    text = F.trim(F.regexp_replace(F.array_join("x.t", "\n"), r"[ \t]{2,}", " "), F.lit(" \t\n\r"))
    flat = whole.select(doc, "section", num.alias("num"), title.alias("title"), F.coalesce("h.stops", F.lit(False)).alias("stops"), (F.coalesce("h.late", F.lit(False)) | letter).alias("appendix"), text.alias("text"))
    upto = Window.partitionBy(doc).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    main = F.when(~F.col("stops") & ~F.col("num").contains("."), F.col("title"))
    named = flat.withColumn("parent", F.coalesce(F.last(main, True).over(upto), F.lit("Front matter"))).withColumn("words", T.word_count(F.col("text")))
    return named.where(~F.col("stops") & (F.col("words") >= least)).select(doc, "section", "num", "title", "parent", "appendix", "words", "text")


def folded(sections: DataFrame, doc: str) -> DataFrame:
    """Sections of which no two neighbours share a number: of two such, the shorter text joins the one before it (the
    longer, or the section in front of both). One document's sections are one group."""
    kind = "array<struct<section:int,num:string,title:string,parent:string,appendix:boolean,text:string>>"
    fields = ("section", "num", "title", "parent", "appendix", "text")
    rows = sections.withColumn("section", F.col("section").cast("int")).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("s"))
    wider = lambda into, other: F.struct(*(into[f].alias(f) for f in fields[:-1]), F.concat_ws("\n", into["text"], F.concat(other["num"], F.lit(". "), other["title"]), other["text"]).alias("text"))

    def step(acc: Column, b: Column) -> Column:
        a, size = F.try_element_at(acc, F.lit(-1)), F.size(acc)
        same = F.coalesce(a["num"] == b["num"], F.lit(False))
        longer = F.length(a["text"]) >= F.length(b["text"])
        rest = F.slice(acc, 1, F.greatest(size - 1, F.lit(0)))
        front = F.try_element_at(acc, F.lit(-2))
        before = F.when(size > 1, F.concat(F.slice(acc, 1, F.greatest(size - 2, F.lit(0))), F.array(wider(front, a)))).otherwise(F.array().cast(kind))
        kept = F.when(longer, F.concat(rest, F.array(wider(a, b)))).otherwise(F.concat(before, F.array(b)))
        return F.when(same, kept).otherwise(F.concat(acc, F.array(b))).cast(kind)

    out = rows.select(doc, F.explode(F.aggregate("s", F.array().cast(kind), step)).alias("s"))
    return out.select(doc, "s.*").withColumn("words", T.word_count(F.col("text")))


def usual_title(title: Column, forms: Column) -> Column:
    """A title in capitals takes each word's usual spelling: ``forms`` maps a lower-case word to (spellings, in capitals,
    most frequent mixed spelling). Little words inside are lower-case; a short word mostly in capitals is an acronym."""
    upper = (title == F.upper(title)) & title.rlike(r"\p{L}")

    def word(token: Column, k: Column) -> Column:
        lead, w, tail = (F.regexp_extract(token, r"^([^\p{L}\p{N}_]*)(.*?)([^\p{L}\p{N}_]*)$", n) for n in (1, 2, 3))
        known = F.try_element_at(forms, F.lower(w))
        little = F.lower(w).isin(*LITTLE) & (k > 0)
        acronym = known.isNotNull() & (known["capital"] > known["n"] / 2) & (F.length(w) <= 5)
        plain = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**30)))
        return F.concat(lead, F.when(little, F.lower(w)).when(acronym, w).when(known["mixed"].isNotNull(), known["mixed"]).otherwise(plain), tail)

    return F.when(upper, F.array_join(F.transform(T.words(title), word), " ")).otherwise(title)


def spellings(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(doc, forms): for each word of a text how often it occurs, how often in capitals, and its usual mixed spelling."""
    each = docs.select(doc, F.posexplode(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_-])([\p{L}\p{N}_-]+)(?![\p{L}\p{N}_-])"), F.lit(1))).alias("at", "form"))
    counts = each.groupBy(doc, F.lower("form").alias("word"), "form").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    mixed = (F.col("form") != F.upper("form")) & (F.col("form") != F.lower("form"))
    capital = (F.col("form") == F.upper("form")) & F.col("form").rlike(r"\p{L}")
    best = F.min(F.when(mixed, F.struct((-F.col("n")).alias("k"), "at", "form")))
    words = counts.groupBy(doc, "word").agg(F.sum("n").alias("n"), F.sum(F.when(capital, F.col("n")).otherwise(0)).alias("capital"), best.alias("b"))
    entry = F.struct("word", F.struct("n", "capital", F.col("b.form").alias("mixed")).alias("v"))
    return words.groupBy(doc).agg(F.map_from_entries(F.collect_list(entry)).alias("forms"))


def short_title(title: Column) -> Column:
    """A chapter's title: without its part, capitals eased, 60 characters at most."""
    t = F.trim(F.regexp_replace(F.regexp_replace(title, r"\s*\(part \d+\)$", ""), r"\s+", " "))
    eased = F.when((t == F.upper(t)) & t.rlike(r"\p{L}"), F.initcap(F.lower(t))).otherwise(t)
    return F.when(F.length(eased) <= 60, eased).otherwise(F.concat(F.regexp_replace(F.left(eased, F.lit(57)), r" [^ ]*$", ""), F.lit("...")))


def richest(groups: DataFrame, by: str, order: str, weight: str, most: Column) -> DataFrame:
    """The ``most`` groups of the largest weight, the first of equals, in their own order (``place`` from 1)."""
    rank = Window.partitionBy(by).orderBy(F.desc(weight), order)
    kept = groups.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= most).drop("r")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)))
