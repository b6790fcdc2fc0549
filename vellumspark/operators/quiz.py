"""Quiz questions: validity with reasons, and their spoken form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import text as T

SCHEMA = "id int, question string, options array<string>, answer string, kind string, explanation string"


def fixture(spark: SparkSession) -> DataFrame:
    four = ["A) one", "B) two", "C) three", "D) four"]
    rows = [
        (1, "What is 40?", four, "A", "Detail", "It is 40."),
        (2, "Which?", four[:3], "0", "detail", ""),
        (3, "Which?", ["x", "X", "y", "z"], "0", "detail", ""),
        (4, "Which?", four, "4", "detail", ""),
        (5, "Which?", ["a", "b", "c", "All of the above"], "1", "", ""),
        (6, "Which?", four, "1", "", "It is 99."),
        (7, " ", four, "1", "", ""),
        (8, "Why so?", four, " 2 ", "other", ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def judged(rows: DataFrame, known: list[str]) -> DataFrame:
    """Questions in canonical form, with ``reason``: the first check that fails, in order, or null."""
    options = F.transform("options", lambda o: F.regexp_replace(F.trim(o), r"^\(?[A-Da-d][).:]\s+", ""))
    clean = F.trim(F.coalesce("question", F.lit("")))
    answer = F.trim("answer")
    letter = F.instr(F.lit("ABCD"), F.upper(answer)) - 1
    index = F.when((F.length(answer) == 1) & (letter >= 0), letter).when(answer.rlike(r"^\d+$"), answer.try_cast("int"))
    c = rows.withColumns({"question": clean, "options": options, "answer": index, "explanation": F.trim(F.coalesce("explanation", F.lit("")))})
    c = c.withColumn("kind", F.when(F.lower("kind").startswith("detail"), "detail").otherwise("understanding"))
    said = F.concat_ws(" ", "question", F.try_element_at("options", F.col("answer") + 1), "explanation")
    bad = F.filter(T.stated_numbers(said), lambda n: ~F.array_contains(F.array(*[F.lit(k) for k in known]), T.norm_number(n)))
    reason = (
        F.when(F.col("question") == "", "no question")
        .when(F.col("options").isNull() | (F.size("options") != 4) | F.exists("options", lambda o: F.coalesce(o, F.lit("")) == ""), "needs exactly 4 options")
        .when(F.size(F.array_distinct(F.transform("options", lambda o: F.lower(o)))) < 4, "duplicate options")
        .when(F.col("answer").isNull() | ~F.col("answer").between(0, 3), "no valid answer index")
        .when(F.array_join("options", " ").rlike(r"(?i)\b(all|none) of the above\b"), "all/none of the above")
        .when(F.size(bad) > 0, F.concat(F.lit("number not in the paper: "), F.array_join(bad, ", ")))
    )
    return c.withColumn("reason", reason)


def _dotless(c: Column) -> Column:
    return F.regexp_replace(c, r"\.+$", "")


def speech(rows: DataFrame, total: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, pos, question, answer) as a voice reads them."""
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    each = F.transform("options", lambda o, k: F.concat(F.element_at(letters, k + 1), F.lit(": "), _dotless(o)))
    question = F.concat(
        F.lit("Question "), F.col("pos").cast("string"), F.lit(f" of {total}. "), "question", F.lit(" "), F.array_join(F.slice(each, 1, 3), "; "), F.lit("; or "), F.element_at(each, 4), F.lit(".")
    )
    why = F.when(F.col("explanation") != "", F.concat(F.lit(" "), "explanation")).otherwise("")
    return rows.select(*by, "pos", question.alias("question"), F.concat(F.lit("The answer is "), F.element_at(each, F.col("answer") + 1), F.lit("."), why).alias("answer"))


def markdown(rows: DataFrame, title: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One text for each quiz (``by``): questions with their options, and the key at the end."""
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    options = F.array_join(F.transform("options", lambda o, k: F.concat(F.lit("- "), F.element_at(letters, k + 1), F.lit(". "), o)), "\n")
    asked = F.concat(F.lit("**"), F.col("pos").cast("string"), F.lit(". "), "question", F.lit("**\n\n"), options)
    key = F.concat(F.col("pos").cast("string"), F.lit(". "), F.element_at(letters, F.col("answer") + 1))
    both = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", asked.alias("q"), key.alias("k")))).alias("x"))
    return both.select(*by, F.concat(F.lit(f"# Check your understanding\n\n_{title}_\n\n"), F.array_join("x.q", "\n\n"), F.lit("\n\n## Answers\n\n"), F.array_join("x.k", "\n")).alias("text"))
