"""Papers as text: references in short, lines about a paper, notes, prompts, figures and terms of a paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as T

# Kinds of videos that a request may ask for, and actions on a playlist.
DEPTHS = "summary auto core read deep study full pass1 pass2 pass3".split()
ACTIONS = "add make order rename remove delete export permission".split()
#: Fields of a section's notes that are lists.
NOTE_LISTS = "claims method limitations figures".split()


def short_reference(entry: Column) -> Column:
    """``Title (Surname and colleagues, 2025)`` of a reference entry: authors, title and more, parted by points."""
    parts = F.filter(F.transform(F.split(entry, r"(?<=[a-z\)])\.\s+"), F.trim), lambda p: p != "")
    whole = F.size(parts) > 1
    authors, title = F.when(whole, parts[0]).otherwise(entry), F.when(whole, F.try_element_at(parts, F.lit(2))).otherwise("")
    names = F.filter(F.split(authors, r",\s*(?:and\s+)?|\s+and\s+"), lambda n: F.trim(n) != "")
    surname = F.coalesce(F.element_at(T.words(F.try_element_at(names, F.lit(1))), -1), F.lit(""))
    year = F.coalesce(F.try_element_at(F.regexp_extract_all(entry, F.lit(r"\b((?:19|20)\d\d)\b"), F.lit(1)), F.lit(-1)), F.lit(""))
    head = F.split(title, ":", 2)[0]
    brief = F.when(title.contains(":") & (T.word_count(head) <= 6), head).otherwise(title)
    brief = F.array_join(F.slice(T.words(brief), 1, 9), " ")
    who = F.concat(surname, F.when(F.size(names) > 1, " and colleagues").otherwise(""), F.when(year != "", F.concat(F.lit(", "), year)).otherwise(""))
    return F.when((brief != "") & (surname != ""), F.concat(brief, F.lit(" ("), who, F.lit(")"))).when(brief != "", brief).otherwise(who)


def paper_line(title: Column, authors: Column, venue: Column, year: Column) -> Column:
    """Title, first author (with ``et al.`` for more), venue and year, those that are known."""
    first = F.try_element_at(authors, F.lit(1))
    who = F.when(F.size(authors) > 1, F.concat(first, F.lit(" et al."))).otherwise(first)
    return F.concat_ws(", ", *(F.nullif(F.coalesce(c.cast("string"), F.lit("")), F.lit("")) for c in (title, who, venue, year)))


def venue_year(venue: Column, year: Column) -> Column:
    """The venue with its year, once."""
    v, y = F.coalesce(venue, F.lit("")), F.coalesce(year.cast("string"), F.lit(""))
    return F.concat_ws(" ", F.nullif(v, F.lit("")), F.when((y != "") & ~F.contains(v, y), y))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A prompt without its header, ``{{key}}`` replaced; values that are no strings go in as JSON."""
    text = F.regexp_replace(template, r"(?s)\A---.*?---\s*", "")
    for key, value in values.items():
        text = F.replace(text, F.lit("{{" + key + "}}"), value)
    return text


def json_part(text: Column) -> Column:
    """From the first ``{`` to the last ``}`` of an answer, without code fences; the text itself if there is none."""
    bare = F.trim(F.regexp_replace(F.trim(text, F.lit(" \n\t\r")), r"(?m)^```(?:json)?|```$", ""), F.lit(" \n\t\r"))
    found = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found).otherwise(bare)


def notes(answers: DataFrame, column: str) -> DataFrame:
    """Notes of sections from JSON answers: lists as lists (a lone value is a list of one), key numbers with a value only."""
    v = F.try_parse_json(F.col(column))
    lists = []
    for name in NOTE_LISTS:
        field = F.try_variant_get(v, f"$.{name}", "variant")
        array = F.coalesce(F.schema_of_variant(field).startswith("ARRAY"), F.lit(False))
        one = F.try_variant_get(field, "$", "string")
        value = F.when(array, F.try_variant_get(field, "$", "array<string>")).when(F.coalesce(one, F.lit("")) != "", F.array(one))
        lists.append(F.coalesce(value, F.array().cast("array<string>")).alias(name))
    numbers = F.coalesce(F.try_variant_get(v, "$.key_numbers", "array<struct<value:string,meaning:string>>"), F.array().cast("array<struct<value:string,meaning:string>>"))
    numbers = F.filter(numbers, lambda x: F.coalesce(x["value"], F.lit("")) != "")
    rest = [c for c in answers.columns if c != column]
    return answers.select(*rest, F.try_variant_get(v, "$.summary", "string").alias("summary"), numbers.alias("key_numbers"), *lists)


def names_authors(text: Column, authors: Column) -> Column:
    """A sentence that lists authors itself: it says by whom, or has two of the surnames, letters alone compared."""
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    last = F.array_distinct(F.transform(F.filter(authors, lambda a: F.trim(a) != ""), lambda a: letters(F.element_at(T.words(a), -1))))
    said = F.size(F.filter(last, lambda x: (x != "") & F.contains(letters(text), x)))
    return text.rlike(r"(?i)\b(written|authored)\s+by\b") | (said >= 2)


def acceptable(job: Column, depth: Column, action: Column) -> Column:
    """A request's job name, depth and action are ones that may be asked for."""
    return job.rlike(r"^[\w-]+$") & depth.isin(*DEPTHS) & action.isin(*ACTIONS)


def unlisted(found: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """Identifiers (by) that their playlist does not have yet, each once."""
    return found.join(items.select(*by).distinct(), by, "left_anti").dropDuplicates(by)


def kinds_of_paper(jobs: DataFrame, title: str, done: str, depth: str) -> DataFrame:
    """(title, kinds): the kinds of finished videos of each paper, sorted."""
    return jobs.where(done).groupBy(title).agg(F.sort_array(F.collect_set(F.coalesce(depth, F.lit("summary")))).alias("kinds"))


def figures_to_show(refs: DataFrame, captions: DataFrame, shown: DataFrame, paper: str, chapter: str, order: str) -> DataFrame:
    """(paper, chapter, pos, label): figures that a chapter's notes refer to (column ``ref``), that have a caption and were
    not shown yet, in the order of their first mention."""
    named = refs.withColumn("label", T.figure_label(F.col("ref"))).where("label IS NOT NULL")
    known = named.join(captions.select(paper, "label").distinct(), [paper, "label"], "left_semi").join(shown.select(paper, "label").distinct(), [paper, "label"], "left_anti")
    first = known.groupBy(paper, chapter, "label").agg(F.min(order).alias("at"))
    return first.select(paper, chapter, F.row_number().over(Window.partitionBy(paper, chapter).orderBy("at", "label")).alias("pos"), "label")


def key_terms(terms: DataFrame, by: str, most: int = 10) -> DataFrame:
    """(by, term, place) of terms (by, term, n, at): the most frequent that neither hold nor lie in a more frequent one
    kept, the first ``most``, by first use. One paper's terms are one array."""
    listed = terms.groupBy(by).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "at", "term"))).alias("t"))
    kind = "array<struct<k:bigint,at:int,term:string>>"
    inside = lambda a, b: F.contains(F.lower(a), F.lower(b))

    def step(acc: Column, t: Column) -> Column:
        clash = F.exists(acc, lambda x: inside(x["term"], t["term"]) | inside(t["term"], x["term"]))
        return F.when(clash, acc).otherwise(F.array_append(acc, t)).cast(kind)

    kept = listed.select(by, F.slice(F.aggregate(F.col("t").cast(kind), F.array().cast(kind), step), 1, most).alias("t"))
    ordered = F.array_sort(F.transform("t", lambda x: F.struct(x["at"].alias("at"), x["term"].alias("term"))))
    return kept.select(by, F.posexplode(ordered).alias("place", "x")).select(by, (F.col("place") + 1).alias("place"), F.col("x.term").alias("term"))
