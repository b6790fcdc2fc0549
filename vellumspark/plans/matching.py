"""Matching statements to passages, formulas to sources, terms to their first use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import text as T
from vellumspark.operators import match as M
from vellumspark.plans.base import Book, table

BOOK = Book()

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOKENS = rf"""list_filter(regexp_extract_all(lower(regexp_replace(text, '\[\s*\d+(?:\s*[,–-]\s*\d+)*\s*\]', ' ', 'g')), '[a-z][a-z\-]{{2,}}|\d[\d,]*(?:\.\d+)?'), lambda w: w NOT IN ({_STOP}))"""
_IDF = f"""t AS (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS token FROM documents), i AS (SELECT token, count(*) AS df, ln((SELECT count(*) FROM documents) / (1 + count(*))) AS idf FROM t GROUP BY token)"""


@BOOK.add(f"WITH {_IDF} SELECT token, df, round(idf, 9) AS idf FROM i")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03, TXT-01: document frequency and weight of every token."""
    docs = table(spark, sf_dir, "documents")
    return M.idf(M.token_rows(docs, ["doc_id"], "text"), ["doc_id"], F.lit(docs.count())).select("token", "df", F.round("idf", 9).alias("idf"))


@BOOK.add(f"""WITH {_IDF}, q AS (SELECT item_id, unnest(list_distinct({_TOKENS})) AS token FROM benchmark),
s AS (SELECT q.item_id, t.doc_id, round_even(sum(CASE WHEN regexp_matches(token, '^[0-9]') THEN 3e0 ELSE 1e0 END * idf), 6) AS score FROM q JOIN i USING (token) JOIN t USING (token) GROUP BY ALL)
SELECT item_id, doc_id, score FROM s WHERE score >= 4 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) = 1""")
def best_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-04: for every benchmark passage the document that shares its rarest tokens."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    wanted = M.token_rows(asked, ["item_id"], "text")
    # only tokens that are asked for leave their task
    tokens = M.token_rows(docs, ["doc_id"], "text").join(wanted.select("token").distinct(), "token", "left_semi")
    weights = M.weighted(M.idf(tokens, ["doc_id"], F.lit(docs.count())))
    scored = M.scores(wanted, tokens, "item_id", ["doc_id"], weights).withColumn("score", F.bround("score", 6))
    return M.best(scored, "item_id", ["doc_id"])


@BOOK.add("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def contains_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-17 shape: documents that hold a benchmark passage word for word, without comparing all pairs."""
    return M.containing(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")


