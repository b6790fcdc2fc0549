"""Verification of statements against a source: semi and anti joins on normalised numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as T


def known(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, number): distinct normalised numbers. They are distinct within a text before the exchange."""
    return docs.select(key, F.explode(T.known_numbers(F.col(text))).alias("number")).distinct()


def stated(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, number, mentions): normalised numbers that a text claims."""
    each = docs.select(key, F.explode(T.stated_numbers(F.col(text))).alias("raw"))
    return each.groupBy(key, T.norm_number(F.col("raw")).alias("number")).agg(F.count("*").alias("mentions"))


def unsupported(claims: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """Claims whose number the source with the same key does not have."""
    return claims.join(source, [*on, "number"], "left_anti")


def statuses(rows: DataFrame, claims: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """Numbers, unverified ones, status and verified share of every row."""
    found = claims.join(source.select(*on, "number", F.lit(True).alias("known")), [*on, "number"], "left")
    sums = found.groupBy(*on).agg(F.sum("mentions").alias("numbers"), F.sum(F.when(F.col("known").isNull(), F.col("mentions")).otherwise(0)).alias("unverified"))
    out = rows.join(sums, on, "left").fillna(0, ["numbers", "unverified"])
    share = 1 - F.col("unverified") / F.greatest("numbers", F.lit(1))
    return out.select(*on, "numbers", "unverified", F.when(F.col("unverified") == 0, "ok").otherwise("dropped").alias("status"), F.bround(share, 3).alias("verified"))


def summary(status: DataFrame, by: str) -> DataFrame:
    return status.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "dropped").alias("dropped"),
        F.sum("numbers").alias("numbers"),
        F.sum("unverified").alias("unverified_before"),
    )


#: What is cut with an unsupported citation: its lead, its verb and its "that".
_LEAD = r"(?i)(?:As\s+)?(?:shown\s+in\s+)?"
_VERB = r"\s*(?:shows|reports|lists|indicates|presents|gives|summarizes|reveals)?\s*(?:that)?,?\s*"


def check_labels(rows: DataFrame, figures: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, sentence, changed): a citation stays if its figure exists and, where the sentence has numbers, one of them is
    printed on the figure's page. The phrases of the others are cut in order. As in the reference, the numbers are those of
    the sentence as it then stands, which the cuts before may have changed."""
    printed = lines.select("page", F.explode(T.stated_numbers(F.col("line"))).alias("n")).select("page", T.norm_number(F.col("n")).alias("number")).distinct()
    pattern = r"\b((?:Table|Figure|Fig\.)\s+\d+)\b"
    each = rows.select("id", F.posexplode(F.regexp_extract_all("sentence", F.lit(pattern), F.lit(1))).alias("pos", "mention"))
    placed = each.withColumn("label", T.figure_label(F.col("mention"))).join(figures, "label", "left")
    pages = placed.select("page").distinct().join(printed, "page").groupBy("page").agg(F.collect_set("number").alias("printed"))
    cited = placed.join(pages, "page", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "mention", "page", "printed"))).alias("cited"))

    def step(text, c):
        numbers = F.transform(T.stated_numbers(text), T.norm_number)
        keeps = c["page"].isNotNull() & ((F.size(numbers) == 0) | F.coalesce(F.arrays_overlap(numbers, c["printed"]), F.lit(False)))
        phrase = F.concat(F.lit(_LEAD), F.replace(c["mention"], F.lit("."), F.lit("\\.")), F.lit(_VERB))
        # only the first occurrence goes
        first = F.regexp_substr(text, phrase)
        at = F.position(first, text)
        cut = F.trim(F.concat(F.left(text, at - 1), F.substr(text, at + F.length(first))))
        return F.when(keeps | first.isNull() | (cut == ""), text).otherwise(T.upper_first(cut))

    judged = rows.join(cited, "id", "left")
    new = F.when(F.col("cited").isNull(), F.col("sentence")).otherwise(F.aggregate("cited", F.col("sentence"), step))
    return judged.select("id", new.alias("new"), "sentence").select("id", F.col("new").alias("sentence"), (F.col("new") != F.col("sentence")).alias("changed"))


def accept_explanations(rows: DataFrame, least: int) -> DataFrame:
    """(id, used, accepted, kind) of rows (id, source, explanation)."""
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    fine = (T.word_count(F.col("explanation")) >= least) & (F.size(F.array_except(numbers(F.col("explanation")), numbers(F.col("source")))) == 0)
    used = F.when(fine, T.upper_first(F.col("explanation"))).otherwise(F.col("source"))
    return rows.select("id", used.alias("used"), fine.alias("accepted"), F.when(fine, "ok").otherwise("source").alias("kind"))


def extraction_quality(said: DataFrame, source: str, gold: list[str]) -> DataFrame:
    """Precision and recall of (model, raw) number strings; percent signs and points at the end don't count."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "[,%]", ""), r"\.$", "")
    spark = said.sparkSession
    wanted = spark.createDataFrame([(g,) for g in gold], "g string").select(bare(F.col("g")).alias("n")).distinct().withColumn("gold", F.lit(1))
    have = spark.createDataFrame([(source,)], "s string").select(F.explode(F.regexp_extract_all("s", F.lit(r"(\d[\d,]*(?:\.\d+)?%?)"), F.lit(1))).alias("g"))
    have = have.select(bare(F.col("g")).alias("n")).distinct().withColumn("known", F.lit(1))
    marked = said.select("model", bare(F.col("raw")).alias("n")).join(have, "n", "left").join(wanted, "n", "left")
    return marked.groupBy("model").agg(
        F.bround(F.count("known") / F.count("*"), 3).alias("precision"),
        F.bround(F.count_distinct(F.when(F.col("gold") == 1, F.col("n"))) / F.lit(float(len(gold))), 3).alias("recall"),
        F.count("*").alias("numbers"),
    )


def prequestions(rows: DataFrame) -> DataFrame:
    """Rows (id, question, answer, facts) whose question is one and whose answer has only numbers of the facts."""
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    fine = F.col("question").endswith("?") & (T.word_count(F.col("question")) >= 4) & (T.word_count(F.col("answer")) >= 4)
    return rows.where(fine & (F.size(F.array_except(numbers(F.col("answer")), numbers(F.col("facts")))) == 0))


def last_known(rows: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """WIN-11: a row without a value takes that of the row before it."""
    window = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(window))
