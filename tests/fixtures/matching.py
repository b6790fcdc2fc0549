"""Matching statements to passages, formulas to sources, terms to their first use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import latex as X
from vellumspark.operators import match as M
from vellumspark.plans.base import Book

BOOK = Book()


@BOOK.add("""SELECT * FROM (VALUES (1, 1), (2, 3)) AS t(q, s)""")
def best_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-06: the source sentence with most of a sentence's words."""
    q = spark.sql("SELECT * FROM (VALUES (1, 'The ability of each model is estimated here'), (2, 'Difficulty grows with the length of tasks'), (3, 'Too short'), (4, 'Nothing in common with any other words')) AS t(q, text)")
    s = spark.sql("SELECT * FROM (VALUES (1, 'The ability of each model is estimated jointly here'), (2, 'The ability of each model is estimated here too'), (3, 'difficulty grows with the length of all tasks')) AS t(s, text)")
    return M.best_sentence(q, s)


@BOOK.add("""SELECT * FROM (VALUES ('j', 1, 3, 2, 6.6e0), ('j', 2, 9, 2, 4.4e0), ('j', 3, 5, 5, 9.1e0), ('k', 1, 1, 1, 7.2e0)) AS t(job, pos, line, page, score)""")
def followed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-04: the choice that prefers the page chosen before; sequential, so a fold over each job."""
    rows = spark.sql(
        """SELECT * FROM (VALUES ('j', 1, 3, 2, 6.0D, 4), ('j', 1, 4, 9, 6.0D, 4), ('j', 2, 9, 2, 4.0D, 9), ('j', 2, 2, 5, 4.1D, 99), ('j', 3, 5, 5, 7.0D, 5), ('j', 4, 1, 7, 1.0D, 7), ('k', 1, 1, 1, 5.0D, 1)) AS t(job, pos, line, page, score, home)"""
    )
    return M.follow(rows, "job")


@BOOK.add("""SELECT * FROM (VALUES ('a', 0, 0), ('a', 1, 1), ('a', 2, 4)) AS t(paper, i, j)""")
def matched_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-05, AGG-10: equations of pages and sources paired in order."""
    page = spark.createDataFrame(
        [("a", 0, "P ( y i j = 1 ) = σ ( θ i − β j )", ["(1)"]), ("a", 1, "a = b + c", []), ("a", 2, "x ≤ ∑ y k", ["( 4 )"]), ("b", 0, "q", [])], "paper string, i int, text string, nums array<string>"
    )
    source = spark.createDataFrame(
        [("a", 0, r"P(y_{ij}=1) = \sigma(\theta_i - \beta_j)", [1]), ("a", 1, "a = b + c", [2]), ("a", 2, r"m \in N", []), ("a", 3, "z^2 w", []), ("a", 4, r"x \leq \sum y_k", [4]), ("b", 0, "w + v", [])],
        "paper string, j int, latex string, numbers array<int>",
    )
    return M.aligned(page, source, "paper")


_TEX = r"""\documentclass{article}\newcommand{\ab}[1]{\theta_{#1}}\def\R{\mathbb{R}}
\begin{document}
We let $\ab{i}$ be the ability of a model here. Nothing else.
% \begin{equation} hidden \end{equation}
\begin{equation}\label{eq:irt} P = \sigma(\ab{i} - \beta_j), \end{equation}
\begin{align} a &= b \\ c &= d \end{align}
\[ x \in \R \]
\begin{equation*} y = 2 \end{equation*}
\appendix
\begin{equation} z = 3 \end{equation}
\begin{thebibliography}{9} \[ no \] \end{thebibliography}
\end{document}"""


@BOOK.add(r"""SELECT * FROM (VALUES (0, 'equation', 'eq:irt', '1', 1, false, 'P = \sigma(\theta_{i} - \beta_j)'), (1, 'align', '', '2,3', 2, false, 'a &= b \\ c &= d'), (2, 'display', '', '', 1, false, 'x \in \mathbb{R}'), (3, 'equation*', '', '', 1, false, 'y = 2'), (4, 'equation', '', '4', 1, true, 'z = 3')) AS t(pos, env, label, numbers, lines, appendix, latex)""")
def equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display equations of a LaTeX source: macros expanded, numbers as printed, appendix marked, bibliography left out."""
    rows = spark.createDataFrame([(_TEX,)], "source string").select(F.posexplode(X.equations_of(F.col("source"))).alias("pos", "e"))
    return rows.select("pos", "e.env", "e.label", F.array_join(F.transform("e.numbers", lambda n: n.cast("string")), ",").alias("numbers"), "e.lines", "e.appendix", "e.latex")


@BOOK.add(r"""SELECT * FROM (VALUES (0, 'We let $\theta_{i}$ be the ability of a model here.')) AS t(pos, sentence)""")
def math_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose sentences with inline mathematics."""
    return spark.createDataFrame([(_TEX,)], "source string").select(F.posexplode(X.sentences_of(F.col("source"))).alias("pos", "sentence"))


@BOOK.add("""SELECT * FROM (VALUES ('IRT', 2), ('item response', 1), ('latent-trait', 3)) AS t(term, "at")""")
def term_first_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-17, TXT-17: the first sentence that uses each term; a term inside another word is no use."""
    terms = spark.sql("SELECT * FROM (VALUES ('IRT'), ('item response'), ('latent-trait'), ('absent')) AS t(term)")
    sentences = spark.sql("SELECT * FROM (VALUES (0, 'A dirty irt word.'), (1, 'Item  responses are used.'), (2, 'Two IRTs and IRT.'), (3, 'Latent traits matter.')) AS t(pos, text)")
    return M.first_uses(terms, sentences)


@BOOK.add("""SELECT * FROM (VALUES (1, 1), (1, 3), (2, 1), (2, 2)) AS t(script, pos)""")
def unsaid_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-09: sentences that repeat nothing said before; order decides."""
    rows = spark.sql(
        "SELECT * FROM (VALUES (1, 1, 'The model solves forty tasks today'), (1, 2, 'Today the model solves forty tasks'), (1, 3, 'Another fact'), (2, 1, 'a the of'), (2, 2, 'a the of')) AS t(script, pos, text)"
    )
    return M.unsaid(rows, "script", "pos").select("script", "pos")


@BOOK.add("""SELECT * FROM (VALUES (1, 1, 'c'), (1, 2, 'a'), (1, 3, 'b'), (2, 1, 'x')) AS t(chapter, place, id)""")
def title_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-12: the sentence that names the title goes first."""
    rows = spark.sql(
        "SELECT * FROM (VALUES (1, 1, 'a', 'It is long.'), (1, 2, 'b', 'Graph walks matter.'), (1, 3, 'c', 'The paper called Graph walks is here.'), (2, 1, 'x', 'Nothing.')) AS t(chapter, pos, id, text)"
    )
    return M.lead_with(rows, "chapter", "pos", F.lit("Graph walks using data")).select("chapter", "place", "id")
