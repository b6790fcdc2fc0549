"""Layout and speech: fixtures of pages, predicates over the tables' own lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import text as T
from vellumspark.operators import layout as L
from vellumspark.plans.base import Book, table

BOOK = Book()


@BOOK.add("""WITH v AS (SELECT event_type, round_even(value, 0) AS v FROM events), m AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY event_type ORDER BY v) <= 3 THEN 0 ELSE 1 END AS n FROM v), g AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY v ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT event_type, min(v) AS start, count(*) AS members FROM g GROUP BY event_type, g HAVING count(*) >= 4""")
def margins_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06 on the shape of events: one-dimensional clusters of rounded values."""
    return L.clusters(table(spark, sf_dir, "events").select("event_type", F.bround("value").alias("v")), ["event_type"], "v", 3, 4)


@BOOK.add("""SELECT l_returnflag, l_extendedprice AS typical FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) = CAST(floor(count(*) OVER (PARTITION BY l_returnflag) * 0.75e0) AS BIGINT) + 1""")
def typical_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05 on the shape of lineitem: the element at three quarters of the ascending values."""
    return L.at_quarter(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")


@BOOK.add(r"""WITH l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
s AS (SELECT *, len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '')) AS n, length(regexp_replace(trim(line), '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(trim(line), '[^\p{Lu}]', '', 'g')) AS caps FROM l)
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, n <= 8 AND NOT regexp_matches(trim(line), '[.,;:)?!]$') AND (regexp_matches(trim(line), '^([A-H]|\d+)(\.\d+)*\s+\S') OR (letters > 0 AND caps > 0.7e0 * letters) OR n <= 2) AS heading FROM s""")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-05: lines that are headings or labels."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", L.is_heading(F.col("line")).alias("heading"))


@BOOK.add(r"""WITH l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
w AS (SELECT doc_id, pos, line, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS w FROM l),
c AS (SELECT doc_id, pos, line, len(w) AS n, len(list_filter(w, lambda x: regexp_full_match(x, '[(\[\"''“‘•]?[A-Za-z][A-Za-z\-’'']+[.,;:)\]\"''”’?!]*'))) AS wordy, len(list_filter(w, lambda x: regexp_full_match(x, '[\d.,%±×()\-–]+'))) AS numeric FROM w)
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, n > 0 AND wordy >= 0.5e0 * n AND NOT (numeric > 0.4e0 * n AND NOT regexp_matches(line, '[a-z]\.\s|[a-z]\.$')) AS prose FROM c""")
def prose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-08: lines of running text."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", L.is_prose(F.col("line")).alias("prose"))


@BOOK.add(r"""SELECT doc_id, regexp_replace(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '[^0-9a-z]', '', 'g') AS key FROM documents""")
def squashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-02: ASCII letters and digits of the whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", T.squash(F.regexp_replace("text", r"[^\x00-\x7F]", "")).alias("key"))


