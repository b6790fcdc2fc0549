"""Outlines, budgets, scripts and their side files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators import library, quiz
from vellumspark.operators import outline as O
from vellumspark.operators import script as S
from vellumspark.operators import verify as V
from vellumspark.plans.base import Book

BOOK = Book()


@BOOK.add("""SELECT * FROM (VALUES (1, 1, 'Method'), (1, 2, 'Method'), (1, 3, 'Results'), (1, 4, 'Results'), (1, 5, 'Discussion'), (2, 1, 'Method'), (2, 2, 'Results')) AS t(paper, pos, role)""")
def section_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06: roles of sections; one that tells none is method before the first results and results after."""
    rows = spark.sql(
        """SELECT * FROM (VALUES (1, 1, array('Our approach'), ''), (1, 2, array('Experimental Setup'), 'Experiments'), (1, 3, array('Main Results'), ''), (1, 4, array('Something else'), ''), (1, 5, array('Threats to validity'), ''),
        (2, 1, array('Evaluation Metrics'), ''), (2, 2, array('Ablation'), 'Part')) AS t(paper, pos, names, parent)"""
    )
    return O.roles(rows, "paper", "pos").select("paper", "pos", "role")


@BOOK.add("""SELECT * FROM (VALUES ('a', 9), ('b', 2), ('c', 4)) AS t(section, n)""")
def content_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: sentences by distinct numbers, points and figures, with half-even rounding."""
    numbers = [("a", "number", str(k)) for k in range(16)] + [("a", "point", f"p{k}") for k in range(14)] + [("a", "number", "3"), ("a", "figure", "Figure 1"), ("a", "figure", "Table 2")]
    rows = [*numbers, ("b", "point", "x"), ("c", "number", "1"), ("c", "figure", "see Fig. 2"), ("c", "figure", "Figure 2"), ("c", "figure", "Table 3"), ("c", "figure", "none")]
    return O.content_budget(spark.createDataFrame(rows, "section string, kind string, value string"), "section")


@BOOK.add("""SELECT * FROM (VALUES ('abstract', 1), ('s1', 2), ('s2', 3), ('s2.1', 3), ('s2.1.1', 3), ('s3', 4)) AS t(key, g)""")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03: chapters of one main section together."""
    rows = spark.sql("SELECT 1 AS video, * FROM (VALUES (1, 'abstract', ''), (2, 's1', '1'), (3, 's2', '2'), (4, 's2.1', '2.1'), (5, 's2.1.1', '2.1.1'), (6, 's3', '3')) AS t(pos, key, num)")
    return O.top_groups(rows, "video", "pos").select("key", "g")


@BOOK.add("""SELECT * FROM (VALUES (1, '1 Intro', 300), (2, '2 Method,2.1 Data', 1100), (3, '2.2 Model', 1500), (4, 'A Prompts', 50)) AS t(pos, bases, words)""")
def grouped_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04: tiny sections join their neighbour, parts of one section stay together below a limit; a fold in the JVM."""
    rows = spark.sql(
        """SELECT 1 AS paper, * FROM (VALUES (1, '1 Intro', 'Intro', false, 300L), (2, '2 Method', 'Method', false, 100L), (3, '2.1 Data', 'Method', false, 1000L), (4, '2.2 Model', 'Method', false, 1500L), (5, 'A Prompts', 'Method', true, 50L)) AS t(pos, base, parent, appendix, words)"""
    )
    each = rows.groupBy("paper").agg(F.sort_array(F.collect_list(F.struct("pos", "base", "parent", "appendix", "words"))).alias("s"))
    out = each.select(F.posexplode(O.group_sections(F.col("s"))).alias("pos", "g"))
    return out.select((F.col("pos") + 1).alias("pos"), F.array_join("g.bases", ",").alias("bases"), F.col("g.words").cast("int").alias("words"))


@BOOK.add("""SELECT * FROM (VALUES (0, 'Method', 9, 2), (1, 'Method', 6, 1), (2, 'Results', 4, 1)) AS t(pos, role, n, parts)""")
def study_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05: neighbours of one role join up to ten sentences."""
    rows = spark.sql("SELECT array(named_struct('role', 'Method', 'n', 4), named_struct('role', 'Method', 'n', 5), named_struct('role', 'Method', 'n', 6), named_struct('role', 'Results', 'n', 4)) AS g")
    return rows.select(F.posexplode(O.study_segments(F.col("g"))).alias("pos", "s")).select("pos", "s.role", "s.n", "s.parts")


@BOOK.add("""SELECT * FROM (VALUES (1, '2,3'), (2, '1,1'), (3, '3,1')) AS t(id, kept)""")
def fitted_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-07: the longest chapter loses its last sentence until the words fit."""
    rows = spark.sql(
        "SELECT * FROM (VALUES (1, array(array(10L, 10L, 10L), array(10L, 10L, 10L, 10L)), 50L), (2, array(array(50L, 50L), array(50L)), 1L), (3, array(array(1L, 1L, 1L), array(1L)), 99L)) AS t(id, sizes, budget)"
    )
    return rows.select("id", F.array_join(F.transform(O.fit_length(F.col("sizes"), F.col("budget")), lambda n: n.cast("string")), ",").alias("kept"))


@BOOK.add("""SELECT * FROM (VALUES (1, 'Table 1 shows that recall falls.', NULL), (2, 'Precision rises.', 'Table 1'), (3, 'The authors argue that it holds.', NULL), (4, 'It may not.', NULL), (5, 'In Table 1, all is new.', NULL), (6, 'Fixed: Table 1 shows that x.', NULL)) AS t(pos, text, figure)""")
def tidied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-09, TXT-15: repeated leads cut; the figure's name is kept beside the sentence."""
    rows = spark.createDataFrame(
        [
            (1, 1, "A", "Table 1 shows that recall falls.", None, False), (1, 2, "A", "Table 1 shows that precision rises.", None, False), (1, 3, "A", "The authors argue that it holds.", None, False),
            (1, 4, "A", "They note that it may not.", None, False), (1, 5, "B", "In Table 1, all is new.", None, False), (1, 6, "B", "Fixed: Table 1 shows that x.", None, True),
        ],
        "script int, pos int, chapter string, text string, figure string, fixed boolean",
    )
    return S.tidy(rows, "script", "pos").select("pos", "text", "figure")


@BOOK.add("""SELECT * FROM (VALUES ('e1', 0, 'Equation 2. It gives the chance of success.'), ('e1', 1, 'Read aloud, it says: p equals sigma of theta i.'), ('e1', 2, 'Theta i is the ability.'), ('e2', 0, 'This equation.')) AS t(eq, k, text)""")
def equation_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a video says of an equation; answers that can't be said or have unknown numbers are left out."""
    rows = spark.createDataFrame(
        [("e1", "2", "it gives the chance of success", "p equals sigma of theta_i", ["theta_i is the ability", r"\frac is not sayable here", "it is 99 percent sure here"], ["2"]), ("e2", "", r"\sum", "", [], [])],
        "eq string, number string, role string, read_aloud string, explanations array<string>, known array<string>",
    )
    return S.equation_talk(rows)


@BOOK.add("""SELECT '# Glossary: T' || chr(10) || chr(10) || '- **b**: Second term of it all.' || chr(10) || '- **a**: First term of it all.' || chr(10) || '- **c**: Third term of it all.' AS text""")
def glossary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06: terms by first use, unused ones last."""
    rows = spark.sql("SELECT * FROM (VALUES ('a', 'First term of it all.', 5), ('b', 'Second term of it all.', 2), ('c', 'Third term of it all.', NULL)) AS t(term, definition, at)")
    return S.glossary(rows, "T")


@BOOK.add("""SELECT * FROM (VALUES ('IRT', 'A model of ability here.'), ('Patch', 'The change that fixes it.')) AS t(term, definition)""")
def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of answers: cleaned, usable, the first of each by case."""
    rows = spark.sql("SELECT * FROM (VALUES (1, ' IRT. ', 'a  model of ability here.'), (2, 'irt', 'another definition of it here'), (3, 'Patch', 'the change that fixes it.'), (4, 'x', 'too short a term here'), (5, 'word', 'short')) AS t(pos, term, definition)")
    return S.term_rows(rows)


@BOOK.add("""SELECT * FROM (VALUES (1, 'Right Title', 'Jane Roe,ShouB', 'arXiv preprint', 'replaced'), (2, 'A Study of Things', 'X Y', 'ICLR', 'kept'), (3, 'Unknown words only', '', '', 'not found')) AS t(id, title, authors, venue, "check")""")
def checked_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-21: titles and authors checked against the first page."""
    rows = spark.createDataFrame(
        [(1, "Wrong Name Here", ["Jane Roe", "John Doe", "ShouB"], "", "Right Title by Jane Roe1 and ShouB12, preprint", "Right Title"), (2, "A Study of Things", ["X Y"], "ICLR", "A Study of Things X Y", ""), (3, "Unknown words only", ["Q"], "", "page", "also unknown")],
        "id int, title string, authors array<string>, venue string, page string, pdf_title string",
    )
    return S.checked_meta(rows).withColumn("authors", F.array_join("authors", ","))


@BOOK.add("""SELECT * FROM (VALUES (1), (4)) AS t(id)""")
def prequestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to keep in mind: a question, an answer, and no number that the facts don't have."""
    rows = spark.sql(
        "SELECT * FROM (VALUES (1, 'How many tasks are there?', 'There are 2,294 of them.', '2,294 tasks'), (2, 'How many tasks are there', 'There are 2,294 of them.', '2,294 tasks'), (3, 'How many tasks are there?', 'There are 12 of them.', '2,294 tasks'), (4, 'Why does it matter here?', 'Because it helps everyone.', '')) AS t(id, question, answer, facts)"
    )
    return V.prequestions(rows).select("id")


@BOOK.add("""SELECT * FROM (VALUES (1, 1), (2, 1), (3, 3), (4, 3)) AS t(pos, page)""")
def carried_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11: a sentence without a place stays where the one before it was."""
    rows = spark.sql("SELECT 1 AS script, * FROM (VALUES (1, 1), (2, NULL), (3, 3), (4, NULL)) AS t(pos, page)")
    return V.last_known(rows, "script", "pos", "page").select("pos", "page")


@BOOK.add("""SELECT '# Check your understanding' || chr(10) || chr(10) || '_T_' || chr(10) || chr(10) || '**1. Why?**' || chr(10) || chr(10) || '- A. a' || chr(10) || '- B. b' || chr(10) || '- C. c' || chr(10) || '- D. d' || chr(10) || chr(10) || '## Answers' || chr(10) || chr(10) || '1. C' AS text""")
def quiz_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05: a quiz as Markdown."""
    return quiz.markdown(spark.sql("SELECT 1 AS pos, 'Why?' AS question, array('a', 'b', 'c', 'd') AS options, 2 AS answer"), "T")


@BOOK.add("""SELECT * FROM (VALUES ('p', 1, '01 - A'), ('p', 3, '03 - C')) AS t(list, place, folder)""")
def playlist_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-08: finished items numbered in playlist order; unfinished ones keep their number free."""
    rows = spark.sql("SELECT * FROM (VALUES ('p', 1, 'A', true), ('p', 2, 'B', false), ('p', 3, 'C', true)) AS t(list, place, title, done)")
    return rows.where("done").select("list", "place", library.numbered(F.col("place"), F.col("title")).alias("folder"))
