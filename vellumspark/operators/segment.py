"""Segmentation: pages, chunks, prefixes, captions, references, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as T


def pages(docs: DataFrame, key: str) -> DataFrame:
    """(key, page, text): form feeds part the pages."""
    return docs.select(key, F.posexplode(F.split("text", "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)


def chunks(docs: DataFrame, keys: list[str], size: int = 1500) -> DataFrame:
    """(keys, part, title, words, text): texts cut every ``size`` words."""
    split = docs.withColumn("w", T.words(F.trim("text"))).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), ((F.size("w") - 1) / size).cast("int"))
    cut = split.select(*keys, "title", F.explode(F.transform(starts, lambda k: F.struct(k.alias("part"), F.slice("w", k * size + 1, size).alias("w")))).alias("c"))
    named = F.when(F.col("c.part") == 0, F.col("title")).otherwise(F.concat("title", F.lit(" (part "), F.col("c.part") + 1, F.lit(")")))
    return cut.select(*keys, F.col("c.part").alias("part"), named.alias("title"), F.size("c.w").alias("words"), F.array_join("c.w", " ").alias("text"))


def prefix(rows: DataFrame, by: str, order: str, most: int, text: str = "text") -> DataFrame:
    """Rows of each group while the words so far are ``most`` at most."""
    window = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("words_so_far", F.sum(T.word_count(F.col(text))).over(window)).where(F.col("words_so_far") <= most)


def pack_until(texts: Column, size: int) -> Column:
    """Consecutive texts joined into groups of ``size`` words or more; the last may be shorter. A fold inside the JVM."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, t: Column) -> Column:
        n = acc["n"] + T.word_count(t)
        joined = F.when(acc["open"] == "", t).otherwise(F.concat(acc["open"], F.lit(" "), t))
        full = n >= size
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(joined))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.lit("")).otherwise(joined).alias("open"),
            F.when(full, F.lit(0).cast("long")).otherwise(n).alias("n"),
        )

    return F.aggregate(texts, empty, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


#: Typography notes of captions; a fixed value.
FORMAT_NOTE = (
    r"(?i)\b(bold|underline|italic|best and (the )?second|indicates the best|NA means|not applicable|zoom in|best viewed|in color)\b"
)


def caption_sentences(caption: Column, most: int = 2, max_words: int = 34) -> Column:
    """The first sentences of a caption without its label. A note or an over-long sentence is passed over until one is
    kept, and ends the reading after that: what follows the first kept one is kept up to the next such sentence."""
    clean = F.regexp_replace(F.regexp_replace(caption, r"\s+", " "), r"^(Figure|Fig\.|Table)\s*\d+\s*[:.]\s*", "")
    parts = F.filter(F.transform(F.split(clean, r"(?<=[a-z0-9\)\]][.?!])\s+(?=[A-Z(])"), lambda s: F.trim(s)), lambda s: s != "")
    bad = lambda s: s.rlike(FORMAT_NOTE) | (T.word_count(s) > max_words)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("over"))

    def step(acc: Column, s: Column) -> Column:
        closed = F.when(s.rlike(r"[.?!]$"), s).otherwise(F.concat(s, F.lit(".")))
        stop = acc["over"] | (F.size(acc["kept"]) == most)
        return F.struct(
            F.when(stop | bad(s), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(closed))).alias("kept"),
            (stop | (bad(s) & (F.size(acc["kept"]) > 0))).alias("over"),
        )

    return F.aggregate(parts, start, step, lambda acc: acc["kept"])


def narrated_captions(figures: DataFrame, paper: tuple[str, ...] = ()) -> DataFrame:
    """(paper, pos, text, figure) of figures (label, page, y0, caption) in reading order; the first sentence names its
    figure. Without ``paper`` the figures are those of one."""
    each = figures.withColumn("s", caption_sentences(F.col("caption"))).where(F.size("s") > 0)
    rows = each.select(*paper, "page", "y0", "label", F.posexplode("s").alias("k", "s"))
    text = F.when(F.col("k") == 0, F.concat("label", F.lit(": "), "s")).otherwise(F.col("s"))
    order = Window.partitionBy(*(paper or [F.lit(1)])).orderBy("page", "y0", "k")
    return rows.select(*paper, F.row_number().over(order).alias("pos"), text.alias("text"), F.col("label").alias("figure"))


def citation_counts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ref, count, first): how often each reference is cited; ``[1-3]`` cites three, ranges of 20 or more none."""
    groups = F.regexp_extract_all(F.col(text), F.lit(r"\[(\d+(?:\s*[,–-]\s*\d+)*)\]"), F.lit(1))
    parts = texts.select(key, F.posexplode(groups).alias("g", "group")).select(key, "g", F.posexplode(F.split("group", r"\s*,\s*")).alias("p", "part"))
    ends = F.split("part", r"\s*[–-]\s*")
    a, b = F.try_element_at(ends, F.lit(1)).cast("long"), F.try_element_at(ends, F.lit(2)).cast("long")
    spans = parts.select(key, "g", "p", F.when(F.size(ends) == 1, F.array(a)).when((F.size(ends) == 2) & (b - a).between(1, 19), F.sequence(a, F.greatest(a, b))).alias("refs"))
    each = spans.select(key, F.col("g") * 10000 + F.col("p"), F.posexplode("refs").alias("k", "ref")).toDF(key, "at", "k", "ref")
    return each.groupBy(key, "ref").agg(F.count("*").alias("count"), F.min(F.struct("at", "k")).alias("first"))


def most_cited(counts: DataFrame, key: str, k: int) -> DataFrame:
    """The k most cited references of each text; of equals, that cited first."""
    order = Window.partitionBy(key).orderBy(F.desc("count"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "ref", "count", "rank")


def reference_entries(lines: DataFrame, key: str, order: str, line: str = "line") -> DataFrame:
    """(key, ref, entry): numbered entries of a reference list; the lines below an entry continue it up to 400 characters."""
    number = F.regexp_extract(line, r"^\s*\[(\d+)\]\s+", 1)
    first = F.regexp_extract(line, r"^\s*\[\d+\]\s+(.*)$", 1)
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("n", F.when(number != "", number.cast("int"))).withColumn("g", F.count("n").over(window))
    fresh = marked.withColumn("ref", F.last("n", True).over(window)).where((F.col("g") > 0) & (F.trim(line) != ""))
    piece = F.struct(F.col(order).alias("o"), F.trim(F.when(F.col("n").isNotNull(), first).otherwise(F.col(line))).alias("t"))
    joined = fresh.groupBy(key, "g", "ref").agg(F.sort_array(F.collect_list(piece)).alias("parts"))
    entry = F.aggregate("parts", F.lit(""), lambda acc, p: F.when(acc == "", p["t"]).when(F.length(acc) < 400, F.concat(acc, F.lit(" "), p["t"])).otherwise(acc))
    return joined.select(key, "ref", entry.alias("entry"))


_NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
).split()


def number_word(n: Column) -> Column:
    names = F.array(*[F.lit(w) for w in _NUMBER_WORDS])
    return F.when(n.between(0, 20), F.try_element_at(names, n.cast("int") + 1)).otherwise(n.cast("string"))


def structure_tour(sections: DataFrame, paper: tuple[str, ...] = ()) -> DataFrame:
    """(paper, pos, text) of sections (pos, num, title, parent, appendix): a sentence for the paper, each main section, the
    appendix. Without ``paper`` the sections are those of one."""
    body = sections.where(~F.col("num").isin("0", "R") & ~F.col("appendix"))
    top = F.substring_index("num", ".", 1)
    nested = F.col("num").contains(".")
    tops = (
        body.withColumn("top", top)
        .groupBy(*paper, "top")
        .agg(
            F.min("pos").alias("pos"),
            F.min_by(F.when(nested, F.col("parent")).otherwise(F.col("title")), "pos").alias("title"),
            F.sort_array(F.collect_list(F.when(nested, F.struct("pos", "title")))).alias("subs"),
        )
    )
    subs = F.filter(F.col("subs.title"), lambda s: F.lower(s) != F.lower("title"))
    covers = F.when(F.size(subs) > 0, F.concat(F.lit(", covers "), T.listing(F.slice(subs, 1, 4)))).otherwise("")
    each = tops.select(*paper, F.col("pos").alias("o"), F.concat(F.lit("Section "), "top", F.lit(", "), "title", covers, F.lit(".")).alias("text"))
    lead = tops.groupBy(*paper).agg(F.count("*").alias("n")).where("n > 0").select(*paper, F.lit(-1).alias("o"), F.concat(F.lit("The main text has "), number_word(F.col("n")), F.lit(" sections.")).alias("text"))
    names = sections.where("appendix").groupBy(*paper, "title").agg(F.min("pos").alias("p"))
    tail = names.groupBy(*paper).agg(F.sort_array(F.collect_list(F.struct("p", "title"))).alias("t")).where("size(t) > 0")
    tail = tail.select(*paper, F.lit(2**30).alias("o"), F.concat(F.lit("An appendix adds "), T.listing(F.slice(F.col("t.title"), 1, 4)), F.lit(".")).alias("text"))
    return lead.unionByName(each).unionByName(tail).select(*paper, F.row_number().over(Window.partitionBy(*(paper or [F.lit(1)])).orderBy("o")).alias("pos"), "text")


def author_sentences(names: Column, per: int = 6) -> Column:
    """All names: one sentence for up to per + 1, else their number and groups of ``per`` with leads."""
    kept = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: F.coalesce(n, F.lit("")) != "")
    n = F.size(kept)
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), ((n - 1) / per).cast("int"))), lambda k: F.slice(kept, k * per + 1, per))
    led = F.transform(
        groups,
        lambda g, k: F.concat(F.when(k == 0, "They are ").when(k == F.size(groups) - 1, "And finally, ").otherwise("Then "), T.listing(g), F.lit(".")),
    )
    one = F.array(F.concat(F.lit("It was written by "), T.listing(kept), F.lit(".")))
    many = F.concat(F.array(F.concat(F.lit("It has "), n.cast("string"), F.lit(" authors."))), led)
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= per + 1, one).otherwise(many)
