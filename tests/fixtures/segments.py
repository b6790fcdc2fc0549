"""Segmentation of papers: captions, citations, references, structure, headers, pages of HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import text as T
from vellumspark.operators import segment as S
from vellumspark.plans.base import Book

BOOK = Book()


@BOOK.add("""SELECT * FROM (VALUES (1, 1, 'Figure 1: We compare models.', 'Figure 1'), (2, 1, 'It is large.', 'Figure 1'), (3, 3, 'Table 2: Scores of all runs.', 'Table 2')) AS t(pos, page, text, figure)""")
def caption_narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-04, MAP-05, PRD-19: figures narrated by the first sentences of their captions, in reading order."""
    figures = spark.sql(
        """SELECT * FROM (VALUES ('Table 2', 3, 10.0D, 'Table 2. Bold indicates the best. Scores of all runs. Underline: second.'), ('Figure 1', 1, 50.0D, 'Figure 1: We compare models. It is large. A third one.'),
        ('Figure 3', 4, 1.0D, 'Figure 3: Best viewed in color.')) AS t(label, page, y0, caption)"""
    )
    return S.narrated_captions(figures).join(figures.select(F.col("label").alias("figure"), "page"), "figure").select("pos", "page", "text", "figure")


_CITES = r"""SELECT * FROM (VALUES (1, 'As in [3], and [1-3] and [3, 4]; see [5–30] and [7]. Not [a].'), (2, '[2] [1] [2]'), (3, 'none')) AS t(doc, text)"""


@BOOK.add("""SELECT * FROM (VALUES (1, 3, 3), (1, 1, 1), (1, 2, 1), (1, 4, 1), (1, 7, 1), (2, 2, 2), (2, 1, 1)) AS t(doc, ref, count)""")
def cited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08: how often each reference is cited; ranges count each of theirs, ranges of 20 or more none."""
    return S.citation_counts(spark.sql(_CITES), "doc").select("doc", "ref", "count")


@BOOK.add("""SELECT * FROM (VALUES (1, 3, 3, 1), (1, 1, 1, 2), (2, 2, 2, 1), (2, 1, 1, 2)) AS t(doc, ref, count, rank)""")
def most_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09: the two most cited references of each text; of equals, that cited first."""
    return S.most_cited(S.citation_counts(spark.sql(_CITES), "doc"), "doc", 2)


@BOOK.add("""SELECT * FROM (VALUES (1, 1, 'A. One. First title. 2020.'), (1, 2, 'B. Two, C. Three. Second title that runs on. 2021.')) AS t(doc, ref, entry)""")
def reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-13: numbered entries with their continuation lines."""
    rows = spark.sql(
        """SELECT * FROM (VALUES (1, 1, 'References'), (1, 2, '[1] A. One. First title. 2020.'), (1, 3, '[2] B. Two, C. Three. Second title'), (1, 4, '   that runs on. 2021.'), (1, 5, '')) AS t(doc, pos, line)"""
    )
    return S.reference_entries(rows, "doc", "pos")


_SECTIONS = """SELECT * FROM (VALUES (1, '0', 'Front matter', 'Front matter', false), (2, '1', 'Introduction', 'Introduction', false), (3, '2', 'Method', 'Method', false), (4, '2.1', 'Data', 'Method', false),
 (5, '2.2', 'Model', 'Method', false), (6, 'A', 'Prompts', 'Prompts', true), (7, 'A.1', 'Prompts', 'Prompts', true)) AS t(pos, num, title, parent, appendix)"""


@BOOK.add("""SELECT * FROM (VALUES (1, 'The main text has two sections.'), (2, 'Section 1, Introduction.'), (3, 'Section 2, Method, covers Data and Model.'), (4, 'An appendix adds Prompts.')) AS t(pos, text)""")
def structure_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-07: a sentence for the paper, each main section with its subsections, and the appendix."""
    return S.structure_tour(spark.sql(_SECTIONS))


@BOOK.add("""SELECT * FROM (VALUES (1, 0, 'It was written by A and B.'), (2, 0, 'It has 8 authors.'), (2, 1, 'They are A, B, C, D, E and F.'), (2, 2, 'And finally, G and H.'), (3, 0, 'It was written by A.')) AS t(id, pos, text)""")
def author_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-06, TXT-08: all authors by name, seven in one sentence at most, else six a sentence."""
    rows = spark.sql("SELECT * FROM (VALUES (1, array('A', ' B ')), (2, array('A','B','C','D','E','F','G','H')), (3, array('A', '')), (4, array(''))) AS t(id, names)")
    return rows.select("id", F.posexplode(S.author_sentences(F.col("names"))).alias("pos", "text"))


@BOOK.add("""SELECT * FROM (VALUES (1, 1, 'first'), (1, 2, 'second page'), (1, 3, '')) AS t(doc, page, text)""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02: pages of layout text, parted by form feeds."""
    return S.pages(spark.createDataFrame([(1, "first\fsecond page\f")], "doc int, text string"), "doc")


@BOOK.add("""SELECT * FROM (VALUES ('1', 'Introduction', 'full', true), ('2', 'Related work', 'full', true), ('2', 'Related work', 'auto', false), ('1', 'Introduction', 'auto', true), ('A', 'Prompts', 'full', true), ('A', 'Prompts', 'auto', false),
 ('3', 'Acknowledgements', 'full', false), ('3', 'Acknowledgements', 'auto', false)) AS t(num, title, depth, kept)""")
def section_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-02, PRD-03: sections that each kind of reading needs."""
    from vellumspark.operators import outline

    rows = spark.sql(
        """SELECT * FROM (VALUES ('1', 'Introduction', 'Introduction', false), ('2', 'Related work', 'Related work', false), ('A', 'Prompts', 'Prompts', true), ('3', 'Acknowledgements', 'Acknowledgements', false)) AS t(num, title, parent, appendix)
        CROSS JOIN (VALUES ('full'), ('auto'), ('read')) AS d(depth)"""
    )
    kept = outline.needed(F.col("depth"), F.col("title"), F.col("parent"), F.col("appendix"))
    return rows.where("depth <> 'read'").select("num", "title", "depth", kept.alias("kept"))


@BOOK.add("""SELECT * FROM (VALUES (1, 'A and B'), (2, 'A, B and C'), (3, 'A'), (4, '')) AS t(id, text)""")
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-08: items as a phrase."""
    return spark.sql("SELECT * FROM (VALUES (1, array('A', 'B')), (2, array('A', '', 'B', 'C')), (3, array('A')), (4, array(''))) AS t(id, x)").select("id", T.listing(F.col("x")).alias("text"))


@BOOK.add("""SELECT * FROM (VALUES (1, 'Figure 3'), (2, 'Table 12'), (3, 'Figure 4'), (4, NULL)) AS t(id, label)""")
def figure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-09: the figure or table that a text names first."""
    rows = spark.sql("SELECT * FROM (VALUES (1, 'see fig. 3 and Table 2'), (2, 'TABLE 12:'), (3, 'Figure4'), (4, 'Figure A')) AS t(id, s)")
    return rows.select("id", T.figure_label(F.col("s")).alias("label"))


@BOOK.add("""SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false)) AS t(id, limits)""")
def limitation_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-04: section titles that state limits."""
    from vellumspark.operators import outline

    rows = spark.sql("SELECT * FROM (VALUES (1, '5 Threats to Validity'), (2, '2 Method'), (3, 'Future work'), (4, 'Results')) AS t(id, title)")
    return rows.select("id", outline.is_limitation(F.col("title")).alias("limits"))


