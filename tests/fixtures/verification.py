"""Numbers and their verification: extraction, known sets, anti joins, label checks, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import text as T
from vellumspark.operators import verify as V
from vellumspark.plans.base import Book

BOOK = Book()


_CLAIMS = """SELECT * FROM (VALUES
 (1, 'We built 2,294 tasks; 1.96% were solved.', '2,294 tasks, 1.96% solved, 438K lines, 93,139 files, 40% in Table 5.'),
 (2, 'There are 2.1 tests and 93,000 files.', '2,294 tasks, 1.96% solved, 438K lines, 93,139 files, 40% in Table 5.'),
 (3, 'It holds 438,000 lines.', '2,294 tasks, 1.96% solved, 438K lines, 93,139 files, 40% in Table 5.'),
 (4, 'Table 5 and Section 4.2 say so.', 'nothing'),
 (5, 'In 2023, there were 12 of them.', '2023 and 12'),
 (6, 'Figure 3 shows 3.0 points.', 'A gain of 3')) AS t(id, sentence, source)"""


@BOOK.add("""SELECT * FROM (VALUES (1, '2,294', true), (1, '1.96', true), (2, '2.1', false), (2, '93,000', false), (3, '438,000', true),
 (5, '2023', true), (5, '12', true), (6, '3.0', true)) AS t(id, number, found)""")
def claim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-12, SET-01: each stated number of a sentence, and whether its source knows it; labelled numbers are no claims."""
    rows = spark.sql(_CLAIMS)
    return rows.withColumn("number", F.explode(T.stated_numbers(F.col("sentence")))).select(
        "id", "number", F.array_contains(T.known_numbers(F.col("source")), T.norm_number(F.col("number"))).alias("found")
    )


_LABELLED = """SELECT * FROM (VALUES
 (1, 'Table 1 shows that 40 tasks pass.'), (2, 'Table 2 shows that 40 tasks pass.'), (3, 'As shown in Figure 9, the rest fails.'),
 (4, 'Figure 2 reports 7 runs.'), (5, 'No label here.'), (6, 'Figure 2 is nice.')) AS t(id, sentence)"""
_FIGURES = "SELECT * FROM (VALUES ('Table 1', 3), ('Table 2', 4), ('Figure 2', 5)) AS t(label, page)"
_LINES = "SELECT * FROM (VALUES (3, 'of 40 tasks'), (4, 'no number'), (5, 'in 8 runs')) AS t(page, line)"


@BOOK.add("""SELECT * FROM (VALUES (1, 'Table 1 shows that 40 tasks pass.', false), (2, '40 tasks pass.', true), (3, 'The rest fails.', true),
 (4, '7 runs.', true), (5, 'No label here.', false), (6, 'Figure 2 is nice.', false)) AS t(id, sentence, changed)""")
def label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-03, TXT-16: a cited figure must exist, and one of the sentence's numbers stand on its page; else the phrase goes."""
    return V.check_labels(spark.sql(_LABELLED), spark.sql(_FIGURES), spark.sql(_LINES))


@BOOK.add("""SELECT * FROM (VALUES (1, 'It solves 40 tasks now.', true, 'ok'), (2, 'Half of them.', false, 'source'), (3, 'It is 41 of the tasks.', false, 'source')) AS t(id, used, accepted, kind)""")
def explanation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-13, PRD-14: an explanation counts if it has four words and no number but its source's; else the source stands."""
    rows = spark.sql(
        "SELECT * FROM (VALUES (1, 'We solve 40.', 'It solves 40 tasks now.'), (2, 'Half of them.', 'Only half.'), (3, 'It is 41 of the tasks.', 'It is 42 of them.')) AS t(id, source, explanation)"
    )
    return V.accept_explanations(rows, 4)


@BOOK.add("""WITH g AS (SELECT * FROM (VALUES ('2294'), ('12'), ('90000'), ('195'), ('40'), ('51'), ('1.7'), ('300')) AS t(n)),
m AS (SELECT * FROM (VALUES ('a', '2294'), ('a', '12'), ('a', '40'), ('a', '7'), ('b', '51'), ('b', '300')) AS t(model, n)),
s AS (SELECT * FROM (VALUES ('2294'), ('12'), ('40'), ('51'), ('300'), ('195')) AS t(n))
SELECT model, round_even(count(*) FILTER (n IN (SELECT n FROM s)) / count(*), 3) AS precision, round_even(count(DISTINCT n) FILTER (n IN (SELECT n FROM g)) / 8.0, 3) AS recall,
count(*) AS numbers FROM m GROUP BY model""")
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22: precision against the source's numbers and recall of a gold list, for each model's answers."""
    said = spark.sql("SELECT * FROM (VALUES ('a', '2,294'), ('a', '12'), ('a', '40%'), ('a', '7'), ('b', '51'), ('b', '300')) AS t(model, raw)")
    gold = ["2,294", "12", "90,000", "195", "40%", "51", "1.7", "300"]
    return V.extraction_quality(said, "2,294 tasks in 12 projects, 40% of 51 and 300 with 195 lines", gold)
