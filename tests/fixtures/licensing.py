"""Licences, identifiers, venues, and the gate in front of publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import license as L
from vellumspark.plans.base import Book

BOOK = Book()


_TEXTS = r"""SELECT * FROM (VALUES (1, 'under CC BY-ND 4.0'), (2, 'https://creativecommons.org/licenses/by-nc-sa/4.0/'), (3, 'We used a corpus.'), (4, 'CC0 data'), (5, 'CC BY-SA wording'),
 (6, 'Creative Commons Attribution-NonCommercial'), (7, 'creativecommons.org/publicdomain/zero/1.0'), (8, 'licensed CC-BY')) AS t(id, x)"""


@BOOK.add("""SELECT * FROM (VALUES (1, 'CC BY-ND 4.0', false), (2, 'CC BY-NC-SA 4.0', true), (3, '', false), (4, 'CC0 1.0', true), (5, 'CC BY 4.0', true), (6, 'CC BY-NC 4.0', true), (7, 'CC0 1.0', true), (8, 'CC BY 4.0', true)) AS t(id, license, allowed)""")
def license_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder of licence wordings, and the gate."""
    rows = spark.sql(_TEXTS).withColumn("license", L.stated_license(F.col("x")))
    return rows.select("id", "license", L.allows_adaptation(F.col("license")).alias("allowed"))


@BOOK.add("""SELECT * FROM (VALUES ('CC BY 4.0 (arXiv:2510.05096)', true, 'You may publish this video and earn money from it, with or without ads.'), ('', false, 'Do not publish until the authors or the publisher give permission.'),
 ('CC BY-ND 4.0', false, 'Do not publish until the authors or the publisher give permission.'), ('CC BY-NC-SA 4.0', true, 'You may publish this video, but not commercially, and it must carry the same license.')) AS t(license, allowed, may)""")
def publishing_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-22, PRD-01: what a licence lets one do; remarks in brackets don't count."""
    rows = spark.sql("SELECT * FROM (VALUES ('CC BY 4.0 (arXiv:2510.05096)'), (''), ('CC BY-ND 4.0'), ('CC BY-NC-SA 4.0')) AS t(license)")
    return rows.select("license", L.allows_adaptation(F.col("license")).alias("allowed"), L.may_do(F.col("license"), F.lit("")).alias("may"))


@BOOK.add("""SELECT * FROM (VALUES (1, 'CC BY 4.0'), (2, 'CC0 1.0'), (3, ''), (4, NULL), (5, 'CC BY-NC-ND 4.0'), (6, '')) AS t(id, license)""")
def linked_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11: licence links of every kind; an unread page is null, a page without an open licence is empty."""
    rows = spark.sql(
        """SELECT * FROM (VALUES (1, 'abs-license"><a href="http://creativecommons.org/licenses/by/4.0/"'), (2, 'abs-license"> <a href="http://creativecommons.org/publicdomain/zero/1.0/"'),
        (3, 'abs-license"><a href="http://arxiv.org/licenses/nonexclusive-distrib/1.0/"'), (4, NULL), (5, 'abs-license"><a href="http://creativecommons.org/licenses/by-nc-nd/4.0/"'), (6, 'nothing')) AS t(id, html)"""
    )
    return rows.select("id", L.linked_license(F.col("html")).alias("license"))


@BOOK.add("""SELECT * FROM (VALUES (1, 'CC BY 4.0', true), (2, '', true), (3, 'CC0 1.0', true), (4, '', false), (5, 'CC BY-SA 4.0', true)) AS t(id, license, keep)""")
def license_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own text, then the kept answer, then the page; an unread page is asked again, so nothing is kept."""
    rows = spark.sql(
        "SELECT * FROM (VALUES (1, 'CC BY 4.0', NULL, NULL), (2, '', 'none', 'CC BY 4.0'), (3, '', 'CC0 1.0', NULL), (4, '', NULL, NULL), (5, '', NULL, 'CC BY-SA 4.0')) AS t(id, own, kept, asked)"
    )
    known = (F.col("own") != "") | F.col("kept").isNotNull() | F.col("asked").isNotNull()
    return rows.select("id", L.resolved(F.col("own"), F.col("kept"), F.col("asked")).alias("license"), known.alias("keep"))


@BOOK.add("""SELECT * FROM (VALUES (1, 0, '2608.18280'), (1, 1, '2604.00594'), (1, 2, '2310.06770'), (1, 3, 'cs/0601001'), (2, 0, '2212.01479')) AS t(id, pos, preprint)""")
def preprint_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of pasted text, old and new style, without versions and repeats, in order."""
    rows = spark.sql(
        r"""SELECT * FROM (VALUES (1, 'https://arxiv.org/abs/2608.18280v2 and https://arxiv.org/pdf/2604.00594, 2310.06770v3 cs/0601001 2310.06770'), (2, 'see 2212.01479 12.345678'), (3, 'none')) AS t(id, text)"""
    )
    return rows.select("id", F.posexplode(L.preprint_ids(F.col("text"))).alias("pos", "preprint"))


@BOOK.add("""SELECT * FROM (VALUES (1, 0, '2608.18280', ''), (1, 2, '2212.01479', 'https://journal.example/paper.pdf'), (1, 3, '2604.00594', ''), (1, 3, '2310.06770', '')) AS t(list, line, preprint, other)""")
def pasted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20: one row per identifier of a pasted list; another link counts only if its line has one identifier; the first mention of an identifier counts."""
    from vellumspark.operators import library

    rows = spark.sql(
        r"""SELECT * FROM (VALUES (1, 'https://arxiv.org/abs/2608.18280\nnothing here\n2212.01479 https://journal.example/paper.pdf\n2604.00594 2310.06770 https://x.example/y 2608.18280')) AS t(list, text)"""
    )
    return library.pasted(rows, "list")


@BOOK.add("""SELECT * FROM (VALUES (1, 'ESEM 2026', '2026'), (2, 'Nature 12 (2020)', '2020'), (3, 'ICLR 2024', '2024'), (4, '', ''), (5, 'Journal of Tests 2021', '2021')) AS t(id, venue, year)""")
def venue_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue and year from a comment or a journal reference; the reference goes first; nothing is guessed."""
    rows = spark.sql(
        """SELECT * FROM (VALUES (1, 'To appear in ESEM 2026', ''), (2, 'ICML 2019', 'Nature 12 (2020)'), (3, '12 pages, ICLR 2024 oral', ''), (4, '10 pages', ''), (5, 'Published in the Journal of Tests 2021', '')) AS t(id, comment, journal)"""
    )
    found = L.venue(F.col("comment"), F.col("journal"))
    return rows.select("id", found.alias("venue"), F.regexp_extract(found, r"\b((?:19|20)\d\d)\b", 1).alias("year"))
