"""Libraries and playlists: ordering, numbering, states, reuse, titles, tags, quizzes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators import library as L
from vellumspark.operators import outline as O
from vellumspark.operators import quiz as Q
from vellumspark.plans.base import Book

BOOK = Book()


_ITEMS = """SELECT * FROM (VALUES (1, 1, 'C', '2024-03-01', 3.0D, NULL), (1, 2, 'X', '', 2.0D, 9.0D), (1, 3, 'A', '2020-01-01', 4.0D, 5.0D), (1, 4, 'B', '2022-01-01', 5.0D, 7.0D)) AS t(list, pos, title, published, added, made)"""


@BOOK.add("""SELECT * FROM (VALUES ('paper_date', 'A,B,C,X'), ('paper_date_desc', 'C,B,A,X'), ('added', 'X,C,A,B'), ('made', 'A,B,X,C')) AS t(ordering, titles)""")
def playlist_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-01: all four orders of one playlist."""
    items = spark.sql(_ITEMS).withColumn("year", F.lit(None).cast("int"))
    out = None
    for order in ("paper_date", "paper_date_desc", "added", "made"):
        rows = L.ordered(items, "list", order).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]), ",").alias("titles"))
        rows = rows.select(F.lit(order).alias("ordering"), "titles")
        out = rows if out is None else out.unionByName(rows)
    return out


@BOOK.add("""SELECT * FROM (VALUES ('j1', 'Paper A', 2, '02 - Paper A'), ('j2', 'Paper B', 8, '08 - Paper B'), ('j3', 'Paper A', 9, '09 - Paper A')) AS t(job, paper, n, folder)""")
def stable_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-04, SNK-07: a job's paper keeps its number; a new one is above all numbers in use, of owned names and of folders."""
    papers = spark.sql("SELECT * FROM (VALUES ('j1', 'Paper A'), ('j2', 'Paper B'), ('j3', 'Paper A')) AS t(job, paper)")
    owned = spark.sql("SELECT * FROM (VALUES ('02 - Paper A', 'j1'), ('03 - Other', 'j9')) AS t(name, job)")
    folders = spark.sql("SELECT * FROM (VALUES ('07 - On disk'), ('no number')) AS t(name)")
    return L.numbers_for(papers, owned, folders).withColumn("folder", L.numbered(F.col("n"), F.col("paper")))


@BOOK.add("""SELECT * FROM (VALUES ('p1', 3, 30.5e0, '2020-01-01', '2021-05-05', 'a,b', 'done=2,paused=1'), ('p2', 1, 0e0, NULL, NULL, '', 'missing=1')) AS t(list, papers, seconds, first, last, thumbs, states)""")
def playlist_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14, SRT-06: seconds, states, dates and first thumbnails of each playlist."""
    items = spark.sql(
        "SELECT * FROM (VALUES ('p1', 2, 'done', 10.0D, '2021-05-05', 'b'), ('p1', 1, 'done', 20.5D, '2020-01-01', 'a'), ('p1', 3, 'paused', NULL, '', NULL), ('p2', 1, 'missing', NULL, '', NULL)) AS t(list, place, state, seconds, published, thumb)"
    )
    states = F.array_join(F.transform(F.map_entries("states"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return L.playlist_totals(items, "list").select("list", F.col("papers").cast("int").alias("papers"), "seconds", "first", "last", F.array_join("thumbs", ",").alias("thumbs"), states.alias("states"))


@BOOK.add("""SELECT * FROM (VALUES (1, 'done'), (2, 'license'), (3, 'error'), (4, 'making'), (5, 'waiting'), (6, 'not started'), (7, 'paused'), (8, 'missing')) AS t(item, state)""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-11, MAP-12: playlist items with the states of their jobs; an unknown job is missing."""
    items = spark.sql("SELECT id AS item, concat('j', id) AS job FROM range(1, 9)").withColumn("item", F.col("item").cast("int"))
    jobs = spark.sql(
        """SELECT * FROM (VALUES ('j1', true, false, NULL, false, false, 1.0D), ('j2', false, true, NULL, false, false, 0.2D), ('j3', false, false, 'x', false, false, 0.2D), ('j4', false, false, NULL, true, false, 0.2D),
        ('j5', false, false, NULL, false, true, 0.2D), ('j6', false, false, NULL, false, false, 0.0D), ('j7', false, false, NULL, false, false, 0.5D)) AS t(job, done, stopped, error, running, queued, progress)"""
    )
    c = F.col
    state = L.job_state(c("done"), c("stopped"), c("error"), c("running"), c("queued"), c("progress"))
    return items.join(jobs.withColumn("state", state), "job", "left").select("item", F.coalesce("state", F.lit("missing")).alias("state"))


@BOOK.add("""SELECT * FROM (VALUES ('p1', 'j1'), ('p1', 'j3'), ('p2', 'j2'), ('p2', 'j3')) AS t(paper, job)""")
def same_paper_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-10: jobs with a paper's identifier or its title, letters and digits only."""
    papers = spark.sql("SELECT * FROM (VALUES ('p1', '2310.06770', 'Swe Bench'), ('p2', '', 'A: Title!')) AS t(paper, preprint, title)")
    jobs = spark.sql("SELECT * FROM (VALUES ('j1', '2310.06770', 'other'), ('j2', '', 'a title'), ('j3', '2310.06770', 'A Title'), ('j4', '', '')) AS t(job, preprint, title)")
    return L.same_paper(papers, jobs)


@BOOK.add("""SELECT * FROM (VALUES ('p1', 'j3', 'same'), ('p2', 'j3', 'derive')) AS t(paper, job, how)""")
def reusable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-13, JON-15: the newest job of the wanted kind, else the newest to derive from."""
    pairs = spark.sql("SELECT * FROM (VALUES ('p1', 'j1', 'auto'), ('p1', 'j3', 'auto'), ('p1', 'j2', 'auto'), ('p2', 'j2', 'deep'), ('p2', 'j3', 'deep')) AS t(paper, job, want)")
    jobs = spark.sql("SELECT * FROM (VALUES ('j1', 'auto', true), ('j2', 'study', false), ('j3', 'auto', true)) AS t(job, depth, derivable)")
    return L.reusable(pairs, jobs, F.col("want"))


@BOOK.add("""SELECT * FROM (VALUES (1, 'start', NULL), (2, 'skip', 'still being fetched'), (3, 'skip', 'its license (none found) does not allow a video'), (4, 'keep', NULL), (5, 'retry', NULL), (6, 'queued', NULL)) AS t(place, action, reason)""")
def queue_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What making a playlist does with each of its items, and why it skips one."""
    items = spark.sql(
        """SELECT *, 'p' AS playlist, concat('t', place) AS title FROM (VALUES (1, 'ready', 'not started', 'j1', true, false, 'CC BY 4.0', ''), (2, 'fetching', '', NULL, false, false, '', ''), (3, 'ready', '', NULL, false, false, '', ''),
        (4, 'ready', 'done', 'j4', false, false, '', ''), (5, 'ready', 'error', 'j5', true, false, 'CC0 1.0', ''), (6, 'ready', 'waiting', 'j6', false, true, '', '')) AS t(place, status, state, job, allowed, permission, license, error)"""
    )
    return L.queue_plan(items).select("place", "action", "reason")


@BOOK.add("""SELECT * FROM (VALUES (1, 'A Study What (ICLR 2024)'), (2, 'Title NeurIPS 2023'), (3, 'Untitled'), (4, 'One two three four five six seven eight nine ten eleven twelve thirteen... (ICSE 2025)')) AS t(id, name)""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-19: file stems of papers."""
    rows = spark.sql(
        """SELECT * FROM (VALUES (1, 'A Study: What?', 'ICLR 2024', '2024'), (2, 'Title NeurIPS 2023', 'NeurIPS 2023', '2023'), (3, '', '', ''),
        (4, 'One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen', 'ICSE', '2025')) AS t(id, title, venue, year)"""
    )
    return rows.select("id", L.safe_name(F.col("title"), F.col("venue"), F.col("year")).alias("name"))


@BOOK.add("""SELECT * FROM (VALUES (1, 'SWE-bench: Can models fix it? | Explained'), (2, 'SWE-bench | Explained'), (3, 'A research paper | Explained')) AS t(id, title)""")
def video_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-20: titles of a hundred characters at most."""
    rows = spark.createDataFrame([(1, "SWE-bench: Can models fix it?"), (2, "SWE-bench: " + "very long words " * 8), (3, "")], "id int, title string")
    return rows.select("id", L.video_title(F.col("title"), F.lit("Explained")).alias("title"))


@BOOK.add("""SELECT * FROM (VALUES (1, 'research paper,Graph,walks'), (2, 'aaaaaaaaaa,cc')) AS t(id, tags)""")
def tag_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-21, WIN-15, WIN-13, SET-07: tags without repeats by case, as many as fit; one too long is passed over."""
    rows = spark.sql("SELECT * FROM (VALUES (1, array('research paper', 'Graph', 'graph', '', 'walks,'), 500), (2, array('aaaaaaaaaa', 'bbbbbbbbbb', 'cc'), 15)) AS t(id, tags, most)")
    wide, tight = rows.where("most = 500"), rows.where("most = 15")
    pick = lambda df, n: df.select("id", F.array_join(L.within_budget(F.col("tags"), n), ",").alias("tags"))
    return pick(wide, 500).unionByName(pick(tight, 15))


@BOOK.add("""SELECT * FROM (VALUES (1, 0, NULL, 'detail', 'What is 40?'), (2, NULL, 'needs exactly 4 options', NULL, NULL), (3, NULL, 'duplicate options', NULL, NULL), (4, NULL, 'no valid answer index', NULL, NULL),
 (5, NULL, 'all/none of the above', NULL, NULL), (6, NULL, 'number not in the paper: 99', NULL, NULL), (7, NULL, 'no question', NULL, NULL), (8, 2, NULL, 'understanding', 'Why so?')) AS t(id, answer, reason, kind, question)""")
def quiz_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-17: the first reason to reject a question, or its canonical form."""
    return Q.judged(Q.fixture(spark), ["40", "12"]).select("id", F.when(F.col("reason").isNull(), F.col("answer")).alias("answer"), "reason", F.when(F.col("reason").isNull(), F.col("kind")).alias("kind"), F.when(F.col("reason").isNull(), F.col("question")).alias("question"))


@BOOK.add("""SELECT * FROM (VALUES (1, 1, 'u1'), (1, 2, 'd1'), (1, 3, 'u2'), (1, 4, 'u3'), (2, 1, 'd9')) AS t(quiz, place, q)""")
def quiz_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24: understanding and detail in turn while both last, four at most."""
    rows = spark.sql("SELECT * FROM (VALUES (1, 1, 'detail', 'd1'), (1, 2, 'understanding', 'u1'), (1, 3, 'understanding', 'u2'), (1, 4, 'understanding', 'u3'), (1, 5, 'understanding', 'u4'), (2, 1, 'detail', 'd9')) AS t(quiz, pos, kind, q)")
    return O.alternate(rows, "quiz", "kind", "pos", "understanding", 4).select("quiz", "place", "q")


@BOOK.add("""SELECT * FROM (VALUES (1, 'Question 1 of 2. Why? A: one; B: two; C: three; or D: four.', 'The answer is B: two. Because.'), (2, 'Question 2 of 2. How? A: a; B: b; C: c; or D: d.', 'The answer is D: d.')) AS t(pos, question, answer)""")
def quiz_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a quiz says: questions with options, and answers."""
    rows = spark.sql("SELECT * FROM (VALUES (1, 'Why?', array('one.', 'two', 'three', 'four.'), 1, 'Because.'), (2, 'How?', array('a', 'b', 'c', 'd'), 3, '')) AS t(pos, question, options, answer, explanation)")
    return Q.speech(rows, 2)


@BOOK.add("""WITH s AS (SELECT * FROM (VALUES (1, 'a', 4, 2), (1, 'b', 4, 3), (1, 'c', 3, 9)) AS t(g, name, votes, first)) SELECT g, name FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY votes DESC, first) = 1""")
def best_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-05, SRT-03: the best by rank, then by order."""
    rows = spark.sql("SELECT * FROM (VALUES (1, 'a', 4, 2), (1, 'b', 4, 3), (1, 'c', 3, 9)) AS t(g, name, votes, first)")
    return rows.groupBy("g").agg(F.min(F.struct((-F.col("votes")).alias("v"), "first", "name")).alias("b")).select("g", "b.name")
