"""Matching of statements to the passages they come from: inverted index, best match, alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as T

#: A match needs this score; words of it must weigh this share of the rarest word's weight; digits count three times.
LEAST_SCORE, WEAK, DIGIT = 4.0, 2.2, 3.0


def token_rows(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, token), distinct within a text."""
    return rows.select(*key, F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("token"))


def idf(tokens: DataFrame, key: list[str], total: Column) -> DataFrame:
    """(token, df, idf): ln(n / (1 + df)); it may be below 0 for a token of nearly every line."""
    return tokens.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.log(total / (F.lit(1) + F.col("df"))))


def weighted(weights: DataFrame) -> DataFrame:
    digit = F.col("token").rlike("^[0-9]")
    return weights.select("token", (F.when(digit, DIGIT).otherwise(1.0) * F.col("idf")).alias("weight"))


def scores(queries: DataFrame, lines: DataFrame, query: str, line: list[str], weights: DataFrame) -> DataFrame:
    """(query, line, score) of pairs that share a token. Only tokens of queries are joined, so lines without any never
    meet one; sums are partial before the exchange."""
    asked = queries.join(weights, "token")
    return lines.join(asked, "token").groupBy(query, *line).agg(F.sum("weight").alias("score"))


def best(scored: DataFrame, query: str, line: list[str], least: float = LEAST_SCORE) -> DataFrame:
    """The line of the highest score for each query, the first of equals, if it reaches ``least``. One row a task and query."""
    top = scored.groupBy(query).agg(F.min(F.struct((-F.bround("score", 9)).alias("k"), *line)).alias("b"))
    return top.select(query, *(F.col(f"b.{c}").alias(c) for c in line), (-F.col("b.k")).alias("score")).where(F.col("score") >= least)


#: Slots of the table of asked tokens that every task gets: a constant, whatever the passages.
SLOTS = 1 << 18


def _slot(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")


def _with_slots(rows: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """Rows with ``name``: an array that tells of each slot whether a text of ``asked`` (its one column) falls there; null
    if nothing is asked."""
    hit = asked.select(_slot(F.col(asked.columns[0])).cast("long").alias("id")).distinct().withColumn("hit", F.lit(True))
    every = asked.sparkSession.range(SLOTS).join(hit, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("hit"))
    table = every.agg(F.sort_array(F.collect_list(F.struct("id", "hit"))).alias("t"), F.max("hit").alias("any")).select(F.when(F.col("any"), F.col("t.hit")).alias(name))
    return rows.crossJoin(F.broadcast(table))


def containing(passages: DataFrame, docs: DataFrame, passage: str, doc: str) -> DataFrame:
    """(passage, doc) where a document holds a passage word for word.

    Joined on the passage's rarest inner token (its ends may be parts of longer tokens), then verified. A passage of
    fewer than three tokens is joined on its first three characters, a shorter one compared with all documents: of texts
    below three characters there are only as many as pairs of characters, whatever the input. Tokens and characters of
    documents leave their task only where a slot of constant tables is asked for, and none are cut if nothing is.
    """
    asked = lambda c, name: F.filter(c, lambda w: F.get(F.col(name), _slot(w)))
    tokens = T.tokens(F.col("text"))
    inner = passages.withColumn("t", tokens)
    keyed = inner.where(F.size("t") >= 3).select(passage, F.col("text").alias("p"), F.explode(F.array_distinct(F.slice("t", 2, F.greatest(F.size("t") - 2, F.lit(0))))).alias("token"))
    met = _with_slots(docs.select(doc, "text"), keyed.select("token"), "slots").where("slots IS NOT NULL")
    have = met.select(doc, F.explode(F.array_distinct(asked(tokens, "slots"))).alias("token"))
    frequency = have.join(keyed.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    rare = keyed.join(frequency, "token").groupBy(passage).agg(F.min(F.struct("df", "token", "p")).alias("r")).select(passage, "r.token", "r.p")
    candidates = have.join(rare, "token").select(passage, "p", doc).join(docs.select(doc, "text"), doc)
    found = candidates.where(F.contains("text", "p")).select(passage, doc)
    few = inner.where(F.size("t") < 3).select(passage, F.col("text").alias("p"))
    grams = F.array_distinct(asked(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda k: F.substring(F.col("text"), k, F.lit(3))), "slots"))
    short = few.where(F.length("p") >= 3).withColumn("gram", F.left("p", F.lit(3)))
    long = _with_slots(docs.where(F.length("text") >= 3).select(doc, "text"), short.select("gram"), "slots").where("slots IS NOT NULL")
    at = long.select(doc, F.explode(grams).alias("gram")).hint("merge").join(short, "gram")
    by_gram = at.join(docs.select(doc, "text"), doc).where(F.contains("text", "p")).select(passage, doc)
    tiny = few.where(F.length("p") < 3)
    held = docs.join(F.broadcast(tiny.select("p").distinct()), F.contains("text", "p")).select(doc, "p").join(tiny, "p").select(passage, doc)
    return found.unionByName(by_gram).unionByName(held).distinct()


def best_sentence(queries: DataFrame, sentences: DataFrame, share: float = 0.6, least: int = 4) -> DataFrame:
    """(q, s): for each query the sentence with the largest share of its words, the first of equals; ``least`` common
    words and ``share`` of the query are needed."""
    words = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]{3,})"), F.lit(1)), lambda w: F.lower(w)))
    a = queries.withColumn("w", words(F.col("text"))).withColumn("n", F.size("w")).where(F.col("n") >= least).select("q", "n", F.explode("w").alias("word"))
    b = sentences.select("s", F.explode(words(F.col("text"))).alias("word"))
    hits = a.join(b, "word").groupBy("q", "n", "s").agg(F.count("*").alias("hits")).where((F.col("hits") >= least) & (F.col("hits") / F.col("n") >= share))
    return hits.groupBy("q").agg(F.min(F.struct((-F.col("hits")).alias("k"), "s")).alias("b")).select("q", "b.s")


def follow(candidates: DataFrame, job: str) -> DataFrame:
    """(job, pos, line, page, score): the sequential choice. A candidate (pos, line, page, score, home) counts 1.3 on the
    section's page or the next, else 1.1 within two pages, and 1.1 more on the page chosen before; the first of equals
    wins; below LEAST_SCORE nothing is chosen and the page stays. The group of a task is one job."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        page, out = 1, []
        for pos, rows in group.sort_values(["pos", "line"]).groupby("pos"):
            away = rows["page"] - rows["home"]
            factor = np.where(away.between(0, 1), 1.3, np.where(away.abs() <= 2, 1.1, 1.0))
            score = rows["score"].to_numpy() * factor * np.where(rows["page"] == page, 1.1, 1.0)
            k = int(score.argmax())
            if score[k] >= LEAST_SCORE:
                page = int(rows["page"].iloc[k])
                out.append((group[job].iloc[0], int(pos), int(rows["line"].iloc[k]), page, round(float(score[k]), 1)))
        return pd.DataFrame(out, columns=[job, "pos", "line", "page", "score"])

    kind = candidates.schema[job].dataType.simpleString()
    return candidates.groupBy(job).applyInPandas(run, f"{job} {kind}, pos int, line int, page int, score double")


def aligned(left: DataFrame, right: DataFrame, paper: str, threshold: float = 0.5) -> DataFrame:
    """(paper, i, j): equations of a page (i, text, nums) paired in order with those of the source (j, latex, numbers) so
    that the similarity is largest; a pair needs ``threshold``, an equal printed number adds a quarter."""
    from vellumspark.functions.latex import similarity

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("i", ignore_index=True), b.sort_values("j", ignore_index=True)
        value = np.zeros((len(a), len(b)))
        for i, x in a.iterrows():
            stated = {n.strip("() ") for n in x["nums"]}
            for j, y in b.iterrows():
                value[i, j] = similarity(x["text"], y["latex"]) + (0.25 if stated & {str(k) for k in y["numbers"]} else 0)
        best = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                pair = best[i, j] + value[i, j] if value[i, j] >= threshold else -1.0
                best[i + 1, j + 1] = max(pair, best[i, j + 1], best[i + 1, j])
        i, j, pairs = len(a), len(b), []
        while i and j:
            if value[i - 1, j - 1] >= threshold and best[i, j] == best[i - 1, j - 1] + value[i - 1, j - 1]:
                i, j = i - 1, j - 1
                pairs.append((key[0], int(a["i"][i]), int(b["j"][j])))
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
        return pd.DataFrame(pairs, columns=[paper, "i", "j"])

    kind = left.schema[paper].dataType.simpleString()
    return left.groupBy(paper).cogroup(right.groupBy(paper)).applyInPandas(run, f"{paper} {kind}, i int, j int")


def unsaid(rows: DataFrame, script: str, order: str, threshold: float = 0.6) -> DataFrame:
    """Sentences of each script that are no near-duplicate of one kept before (words and digits, ten little words apart).
    Order decides, so a script is one group."""
    little = {"the", "a", "an", "of", "and", "to", "in", "is", "are", "for"}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import re

        kept, sets = [], []
        for k, text in enumerate(group.sort_values(order)["text"]):
            words = set(re.findall("[a-z0-9]+", text.lower())) - little
            if not any(words and s and len(words & s) / len(words | s) >= threshold for s in sets):
                kept.append(k)
                sets.append(words)
        return group.sort_values(order).iloc[kept]

    return rows.groupBy(script).applyInPandas(run, rows.schema)


def first_uses(terms: DataFrame, sentences: DataFrame) -> DataFrame:
    """(term, at): the first sentence that uses a term. Acronyms match by case and take an s; other terms take any blank
    or hyphen between their words, and s or es. Joined on the term's first word, then verified by its pattern."""
    term = F.trim("term")
    acronym = term.rlike(r"^[A-Z0-9][A-Za-z0-9\-]{1,9}$") & (F.length(F.regexp_replace(term, "[^A-Z]", "")) >= 2)
    parts = F.filter(F.split(term, r"[\s\-]+"), lambda w: w != "")
    quoted = F.transform(parts, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    pattern = F.when(acronym, F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), term, F.lit(r"\Es?(?![A-Za-z0-9])"))).otherwise(
        F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])"), F.array_join(quoted, r"[\s\-]+"), F.lit(r"(?:s|es)?(?![A-Za-z0-9])"))
    )
    stem = lambda c: F.regexp_replace(F.lower(c), "(es|s)$", "")
    keyed = terms.select("term", pattern.alias("pattern"), stem(F.regexp_extract(parts[0], "^([A-Za-z0-9]+)", 1)).alias("k"))
    words = sentences.select("pos", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1)))).alias("w"))
    near = words.withColumn("k", stem(F.col("w"))).join(keyed, "k").where(F.expr("regexp_like(text, pattern)"))
    return near.groupBy("term").agg(F.min("pos").alias("at"))


def lead_with(rows: DataFrame, by: str, order: str, title: Column) -> DataFrame:
    """Rows with ``place``: the one that names most of a title's words (and of equals one that calls it something) goes
    first, the rest keep their order."""
    skip = F.array(*[F.lit(w) for w in ("with", "from", "that", "this", "using", "based", "towards", "into")])
    words = F.filter(F.transform(F.regexp_extract_all(title, F.lit("([A-Za-z0-9]{4,})"), F.lit(1)), lambda w: F.lower(w)), lambda w: ~F.array_contains(skip, w))
    hits = F.size(F.filter(words, lambda w: F.lower("text").contains(w)))
    named = F.lower("text").rlike(r"\b(titled|called|named|paper|benchmark|framework|model|system|study)\b") & (hits > 0)
    scored = rows.withColumn("hits", hits).withColumn("named", named.cast("int"))
    first = Window.partitionBy(by).orderBy(F.desc("hits"), F.desc("named"), order)
    marked = scored.withColumn("r", F.row_number().over(first))
    lead = F.when((F.col("r") == 1) & (F.col("hits") > 0), 0).otherwise(1)
    return marked.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(lead, order))).drop("hits", "named", "r")
