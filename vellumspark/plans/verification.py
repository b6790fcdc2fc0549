"""Numbers and their verification: extraction, known sets, anti joins, label checks, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators import verify as V
from vellumspark.plans.base import Book, table

BOOK = Book()

#: DuckDB has no look-behind: the character before a number is matched with it.
_NUMBERS = r"regexp_extract_all(text, '(^|[^\p{L}\p{N}_.])(\d(?:[\d,]*\d)?(?:\.\d+)?)', 2)"
_NORM = "CASE WHEN contains(n, '.') THEN coalesce(nullif(rtrim(rtrim(replace(n, ',', ''), '0'), '.'), ''), '0') ELSE replace(n, ',', '') END"
_KILO = r"regexp_extract_all(text, '(^|[^\p{L}\p{N}_.])(\d(?:[\d,]*\d)?(?:\.\d+)?)[kK]\b', 2)"
_KNOWN = f"""
raw AS (SELECT doc_id, unnest({_NUMBERS}) AS n FROM documents),
kilo AS (SELECT doc_id, CAST(CAST(CAST(replace(n, ',', '') AS DECIMAL(28,6)) * 1000 AS DECIMAL(28,3)) AS VARCHAR) AS n FROM (SELECT doc_id, unnest({_KILO}) AS n FROM documents)),
known AS (SELECT DISTINCT doc_id, {_NORM} AS number FROM (SELECT * FROM raw UNION ALL SELECT * FROM kilo))"""


@BOOK.add(f"WITH {_KNOWN} SELECT doc_id, number FROM known")
def doc_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-03, AGG-01: the distinct normalised numbers of every document."""
    return V.known(table(spark, sf_dir, "documents"), "doc_id")


@BOOK.add(f"""WITH {_KNOWN}, stated AS (SELECT doc_id, {_NORM} AS number, count(*) AS mentions FROM raw GROUP BY ALL)
SELECT s.doc_id, s.number, s.mentions FROM stated s ANTI JOIN known k ON k.doc_id = s.doc_id - 1 AND k.number = s.number""")
def unverified_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-01: numbers of a document that its predecessor does not know."""
    docs = table(spark, sf_dir, "documents")
    source = V.known(docs, "doc_id").withColumn("doc_id", F.col("doc_id") + 1)
    return V.unsupported(V.stated(docs, "doc_id"), source, ["doc_id"])


@BOOK.add(f"""WITH {_KNOWN}, stated AS (SELECT doc_id, {_NORM} AS number, count(*) AS mentions FROM raw GROUP BY ALL),
j AS (SELECT s.*, k.number IS NOT NULL AS found FROM stated s LEFT JOIN known k ON k.doc_id = s.doc_id - 1 AND k.number = s.number)
SELECT d.doc_id, CAST(coalesce(sum(mentions), 0) AS BIGINT) AS numbers, CAST(coalesce(sum(mentions) FILTER (NOT found), 0) AS BIGINT) AS unverified,
CASE WHEN coalesce(sum(mentions) FILTER (NOT found), 0) = 0 THEN 'ok' ELSE 'dropped' END AS status,
round_even(1 - coalesce(sum(mentions) FILTER (NOT found), 0) / greatest(coalesce(sum(mentions), 0), 1), 3) AS verified
FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id GROUP BY d.doc_id""")
def verification_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-02: status of every document against its predecessor; without numbers it is verified (share 1)."""
    docs = table(spark, sf_dir, "documents")
    source = V.known(docs, "doc_id").withColumn("doc_id", F.col("doc_id") + 1)
    return V.statuses(docs.select("doc_id"), V.stated(docs, "doc_id"), source, ["doc_id"])


@BOOK.add(f"""WITH {_KNOWN}, stated AS (SELECT doc_id, {_NORM} AS number, count(*) AS mentions FROM raw GROUP BY ALL),
j AS (SELECT s.*, k.number IS NOT NULL AS found FROM stated s LEFT JOIN known k ON k.doc_id = s.doc_id - 1 AND k.number = s.number),
p AS (SELECT d.doc_id, d.source, coalesce(sum(mentions), 0) AS n, coalesce(sum(mentions) FILTER (NOT found), 0) AS bad FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id GROUP BY ALL)
SELECT source, count(*) AS total, count(*) FILTER (bad = 0) AS ok, count(*) FILTER (bad > 0) AS dropped, CAST(sum(n) AS BIGINT) AS numbers, CAST(sum(bad) AS BIGINT) AS unverified_before FROM p GROUP BY source""")
def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02: counts of statuses and numbers by source."""
    docs = table(spark, sf_dir, "documents")
    status = verification_status(spark, sf_dir)
    return V.summary(status.join(docs.select("doc_id", "source"), "doc_id"), "source")


