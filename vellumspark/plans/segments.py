"""Segmentation of papers: captions, citations, references, structure, headers, pages of HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as T
from vellumspark.operators import segment as S
from vellumspark.plans.base import Book, table

BOOK = Book()


@BOOK.add(r"""SELECT doc_id, CAST(k AS BIGINT) AS ref, count(*) AS count FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\[(\d{1,9})\]', 1)) AS k FROM documents) GROUP BY ALL""")
def document_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08 over all documents."""
    return S.citation_counts(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "ref", "count")


@BOOK.add(r"""WITH w AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
RECURSIVE_F AS (WITH RECURSIVE f AS (SELECT conv_id, k, n AS size, 0 AS g, CASE WHEN n >= 60 THEN 1 ELSE 0 END AS closed, n FROM w WHERE k = 1
 UNION ALL SELECT w.conv_id, w.k, CASE WHEN f.closed = 1 THEN w.n ELSE f.size + w.n END, f.g + f.closed, CASE WHEN (CASE WHEN f.closed = 1 THEN w.n ELSE f.size + w.n END) >= 60 THEN 1 ELSE 0 END, w.n FROM f JOIN w ON w.conv_id = f.conv_id AND w.k = f.k + 1)
 SELECT * FROM f)
SELECT conv_id, CAST(g AS INTEGER) AS pos, CAST(sum(n) AS BIGINT) AS words FROM RECURSIVE_F GROUP BY conv_id, g""")
def packed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-02: consecutive turns joined into groups of 60 words or more, by a fold inside the JVM."""
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    packed = texts.select("conv_id", F.posexplode(S.pack_until(F.col("t.text"), 60)).alias("pos", "text"))
    return packed.select("conv_id", "pos", T.word_count(F.col("text")).alias("words"))


@BOOK.add(r"""WITH l AS (SELECT doc_id, regexp_replace(lower(line), '[^0-9a-z]', '', 'g') AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
m AS (SELECT doc_id, regexp_replace(s, '\d+', '#', 'g') AS key FROM l WHERE s <> '')
SELECT key, count(*) AS lines, count(DISTINCT doc_id) AS documents FROM m GROUP BY key HAVING count(*) >= 3""")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07: lines that repeat three times or more once letters and digits alone count and numbers are masked."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    key = F.regexp_replace(T.squash(F.col("line")), r"[0-9]+", "#")
    return lines.select("doc_id", key.alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("lines"), F.count_distinct("doc_id").alias("documents")).where("lines >= 3")


@BOOK.add(r"""WITH x AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM x""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03 shape: text of markup, scripts and styles dropped, entities unescaped, white space collapsed."""
    from vellumspark.sources import markup

    return table(spark, sf_dir, "pages").select("page_id", markup.text_of(F.col("html")).alias("text"))


@BOOK.add(r"""SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS link FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20 shape: the distinct links of every page."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("link"))


@BOOK.add(r"""WITH w AS (SELECT doc_id, lower(word) AS word, word AS form FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS word FROM documents)),
c AS (SELECT word, form, count(*) AS n FROM w GROUP BY ALL)
SELECT word, form, n FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, form) = 1""")
def usual_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19: the most frequent spelling of each word; counted before the exchange, so a frequent word is one row a task."""
    forms = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), F.lit(1))).alias("form"))
    counts = forms.groupBy(F.lower("form").alias("word"), "form").agg(F.count("*").alias("n"))
    best = counts.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("k"), "form")).alias("b"))
    return best.select("word", F.col("b.form").alias("form"), (-F.col("b.k")).alias("n"))


@BOOK.add(r"""WITH l AS (SELECT lang, doc_id, n_chars, CAST(length(text) AS BIGINT) AS chars FROM documents), s AS (SELECT lang, CAST(floor(n_chars / 100) AS BIGINT) AS size, sum(chars) AS chars, min(doc_id) AS first FROM l GROUP BY ALL)
SELECT lang, size, CAST(chars AS BIGINT) AS chars FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY chars DESC, first) = 1""")
def body_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04: a mode weighted by characters, for each language; ties go to the first seen."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.floor(F.col("n_chars") / 100).alias("size"), F.length("text").cast("long").alias("chars"))
    sums = docs.groupBy("lang", "size").agg(F.sum("chars").alias("chars"), F.min("doc_id").alias("first"))
    best = Window.partitionBy("lang").orderBy(F.desc("chars"), "first")
    return sums.withColumn("r", F.row_number().over(best)).where("r = 1").select("lang", "size", "chars")
