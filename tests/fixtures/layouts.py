"""Layout and speech: fixtures of pages, predicates over the tables' own lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import speak, unicode
from vellumspark.operators import layout as L
from vellumspark.plans.base import Book

BOOK = Book()

_WORDS = """SELECT * FROM (VALUES (1, 300.0D, 100.0D, 337.0D, 110.0D, 'Figure'), (1, 346.0D, 101.0D, 400.0D, 110.0D, '1:'), (1, 50.0D, 100.0D, 120.0D, 110.0D, 'left'), (1, 123.0D, 102.0D, 160.0D, 111.0D, 'column'), (1, 50.0D, 120.0D, 90.0D, 130.0D, 'below'), (2, 5.0D, 5.0D, 9.0D, 9.0D, 'two'))
 AS t(page, x0, y0, x1, y1, text)"""


@BOOK.add("""SELECT * FROM (VALUES (1, 50.0e0, 100.0e0, 'left column', 2, 0), (1, 300.0e0, 100.0e0, 'Figure 1:', 2, 1), (1, 50.0e0, 120.0e0, 'below', 1, 0), (2, 5.0e0, 5.0e0, 'two', 1, 0)) AS t(page, x0, y0, text, n, gaps)""")
def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14, LAY-01, SRC-05: words to lines; a row hangs on its first word, columns part at a gap."""
    return L.lines(spark.sql(_WORDS), ["page"]).select("page", "x0", "y0", "text", "n", F.size("gaps").alias("gaps"))


@BOOK.add("""SELECT * FROM (VALUES ('title', 1), ('l1', 2), ('l2', 3), ('r1', 4), ('wide', 5), ('l3', 6), ('r2', 7)) AS t(id, place)""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-02, SRC-04: blocks across the page cut bands; a band is read column by column."""
    rows = spark.sql(
        """SELECT 1 AS page, 600.0D AS w, * FROM (VALUES ('l1', 50.0D, 100.0D, 290.0D), ('r1', 310.0D, 100.0D, 550.0D), ('title', 50.0D, 20.0D, 550.0D), ('l2', 50.0D, 200.0D, 290.0D), ('wide', 50.0D, 300.0D, 550.0D), ('r2', 310.0D, 400.0D, 550.0D), ('l3', 50.0D, 410.0D, 290.0D)) AS t(id, x0, y0, x1)"""
    )
    return L.reading_order(rows, ["page"], "w").select("id", "place")


@BOOK.add("""SELECT * FROM (VALUES ('f1', 'left'), ('f1', 'column')) AS t(figure, text)""")
def words_in_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-07, PRD-16, MAP-11: words whose middle lies in a figure of their page."""
    boxes = spark.sql("SELECT * FROM (VALUES ('f1', 1, 40.0D, 95.0D, 170.0D, 115.0D), ('f2', 2, 100.0D, 100.0D, 200.0D, 200.0D)) AS t(figure, page, bx0, by0, bx1, by1)")
    return L.inside(spark.sql(_WORDS), boxes, "page", 1.0).select("figure", "text")


@BOOK.add("""SELECT * FROM (VALUES (1, 1, 2), (1, 2, 3)) AS t(page, i, below)""")
def lines_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-20: the nearest line below in the same column; subscripts are no lines."""
    rows = spark.sql(
        """SELECT 1 AS page, * FROM (VALUES (1, 50.0D, 100.0D, 290.0D, 110.0D), (2, 50.0D, 112.0D, 290.0D, 122.0D), (3, 52.0D, 124.0D, 280.0D, 134.0D), (4, 310.0D, 112.0D, 550.0D, 122.0D), (5, 50.0D, 111.0D, 60.0D, 114.0D)) AS t(i, x0, y0, x1, y1)"""
    )
    return L.next_lines(rows.where("i <= 4").unionByName(rows.where("i = 5")), ["page"]).where("i <= 3")


@BOOK.add("""SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, true), (5, false), (6, false)) AS t(id, formula)""")
def formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-10: lines that are formulas, not prose with a sign, code or an address."""
    rows = spark.createDataFrame(
        [(1, "P ( y = 1 ) = σ ( θ i − β j )"), (2, "We set the value of x = 3 because models often need larger budgets"), (3, "x == y"), (4, "arg max θ ∑ log p ( x )"), (5, "https://a.b/c?d=e&f"), (6, "no operator")],
        "id int, line string",
    )
    return rows.select("id", L.is_formula(F.col("line")).alias("formula"))


@BOOK.add("""SELECT * FROM (VALUES ('accuracy.', true, true), ('et', false, false), ('al.', false, false), ('A.', false, false), ('3.', true, false), ('(2)', false, false), ('end."', true, true), ('e.g.', false, false), ('why?', true, true)) AS t(word, sentence, item)""")
def sentence_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-06, PRD-07: words that end a sentence, in both readings."""
    rows = spark.createDataFrame([(w,) for w in ("accuracy.", "et", "al.", "A.", "3.", "(2)", 'end."', "e.g.", "why?")], "word string")
    return rows.select("word", L.ends_sentence(F.col("word")).alias("sentence"), L.ends_item(F.col("word")).alias("item"))


@BOOK.add("""SELECT * FROM (VALUES (1, 0, 'An individual state-of-the-art result ends here.'), (1, 1, 'Then more')) AS t(doc, g, text)""")
def joined_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-10, TXT-11: words to sentences across lines; broken words joined, compounds kept."""
    words = [("An", False), ("individ-", True), ("ual", False), ("state-of-", True), ("the-art", False), ("result", True), ("ends", False), ("here.", False), ("Then", False), ("more", True)]
    rows = spark.createDataFrame([(1, k, w, e) for k, (w, e) in enumerate(words)], "doc int, pos int, w string, eol boolean")
    return L.joined_words(L.sentence_runs(rows, ["doc"], "pos"), ["doc", "g"], "pos")


@BOOK.add("""SELECT * FROM (VALUES (1, 2, 10.0e0, 5.0e0, 60.0e0, 30.0e0)) AS t(s, page, x0, y0, x1, y1)""")
def sentence_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20, AGG-21: the page with most of a sentence, and the union of its boxes there."""
    rows = spark.sql("SELECT * FROM (VALUES (1, 1, 500.0D, 700.0D, 550.0D, 710.0D), (1, 2, 10.0D, 5.0D, 40.0D, 15.0D), (1, 2, 20.0D, 20.0D, 60.0D, 30.0D)) AS t(s, page, x0, y0, x1, y1)")
    return L.dominant_page(rows, ["s"])


@BOOK.add("""SELECT * FROM (VALUES ('Figure 1', 1), ('Table 2', 3)) AS t(label, page)""")
def caption_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-03: captions begin their line; later mentions don't count."""
    rows = spark.sql("SELECT * FROM (VALUES (1, 10.0D, 50.0D, 'Figure 1: A plot'), (2, 10.0D, 50.0D, 'Figure 1. again'), (2, 10.0D, 90.0D, 'see Table 2: no'), (3, 10.0D, 90.0D, 'TABLE 2. Scores'), (3, 10.0D, 95.0D, 'Table of contents')) AS t(page, x0, y0, text)")
    return L.captions(rows, ["page"]).select("label", "page")


@BOOK.add("""SELECT * FROM (VALUES (1, 'Journal 1'), (2, 'Journal 2'), (3, 'Journal 3'), (4, '12')) AS t(page, text)""")
def running_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, PRD-20: running headers and page numbers."""
    rows = spark.sql("SELECT 1 AS paper, 800.0D AS h, * FROM (VALUES (1, 10.0D, 20.0D, 'Journal 1'), (2, 10.0D, 20.0D, 'Journal 2'), (3, 10.0D, 20.0D, 'Journal 3'), (4, 10.0D, 20.0D, 'Title'), (4, 780.0D, 790.0D, '12'), (2, 300.0D, 310.0D, 'Journal 9')) AS t(page, y0, y1, text)")
    return L.running_edges(rows, "paper", "h").select("page", "text")


@BOOK.add("""SELECT * FROM (VALUES (1, 'two thousand two hundred and ninety-four tasks'), (2, 'fourteen percent'), (3, 'Stages one and two filter.'), (4, 'The I V estimate'), (5, 'one point nine six percent of L L Ms in nineteen ninety-nine.'), (6, 'about five, for example, alpha is at least one'), (7, 'World War two and (one) or (two)')) AS t(id, spoken)""")
def spoken_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech: numbers, years, numerals, acronyms and signs in words."""
    rows = spark.createDataFrame(
        [(1, "2,294 tasks"), (2, "14.0%"), (3, "Stages I and II filter."), (4, "The IV estimate"), (5, "1.96% of LLMs in 1999."), (6, "~5, e.g. α is ≥1"), (7, "World War II and (i) or (ii)")], "id int, text string"
    )
    return rows.select("id", speak.to_spoken(F.col("text")).alias("spoken"))


@BOOK.add("""SELECT * FROM (VALUES (1, 'theta i', true), (2, 'beta j squared', true), (3, 'f j', true), (4, 'x hat', true), (5, '\\frac{a}{b}', false)) AS t(id, said, clean)""")
def said_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-11: left-over notation in words, and whether all of it could be said."""
    rows = spark.createDataFrame([(1, r"theta_i"), (2, r"$\beta_j^2$"), (3, "f_{j}"), (4, r"\hat{x}"), (5, r"\frac{a}{b}")], "id int, text string")
    said = speak.say_math(F.col("text"))
    return rows.select("id", said.alias("said"), speak.clean(said).alias("clean"))


@BOOK.add("""SELECT * FROM (VALUES (1, 'rq1'), (2, 'officefi')) AS t(id, key)""")
def compatibility_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-02: mathematical letters and ligatures become plain ones."""
    return spark.createDataFrame([(1, "𝑅𝑄1"), (2, "Oﬃce ﬁ")], "id int, s string").select("id", unicode.squash(F.col("s")).alias("key"))
