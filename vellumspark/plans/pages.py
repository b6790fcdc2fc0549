"""Documents as typeset pages. Lines of 50 make a page; the words of a line stand 30 points apart, every ninth 20 more, odd
ones a point lower, so that every operator on words, lines and blocks runs over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as T
from vellumspark.operators import layout as L
from vellumspark.operators import outline as O
from vellumspark.operators import sections as S
from vellumspark.plans.base import Book, table

BOOK = Book()

_LINES = r"l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS r FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"
_WORDS = (
    _LINES
    + r""", w AS (SELECT doc_id, r, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS k, len(t) AS n FROM (SELECT doc_id, r, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS t FROM l)),
b AS (SELECT doc_id, r // 50 AS page, r, k, n, text, 50e0 + 30 * k + 20 * (k // 9) AS x0, 75e0 + 30 * k + 20 * (k // 9) AS x1, 100e0 + 12 * (r % 50) + k % 2 AS y0, 110e0 + 12 * (r % 50) + k % 2 AS y1 FROM w)"""
)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("r", "line"))


def boxed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text_lines(spark, sf_dir).select("doc_id", "r", T.words(F.col("line")).alias("w"))
    words = words.select("doc_id", "r", F.size("w").alias("n"), F.posexplode("w").alias("k", "text"))
    x, y = F.lit(50.0) + 30 * F.col("k") + 20 * F.floor(F.col("k") / 9), F.lit(100.0) + 12 * (F.col("r") % 50) + F.col("k") % 2
    page = F.floor(F.col("r") / 50).cast("int")
    return words.select("doc_id", page.alias("page"), "r", "k", "n", "text", x.alias("x0"), (x + 25).alias("x1"), y.alias("y0"), (y + 10).alias("y1"))


@BOOK.add(f"WITH {_WORDS} SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, string_agg(text, ' ' ORDER BY k) AS text, CAST(count(*) AS INTEGER) AS n, 0 AS gaps FROM b GROUP BY doc_id, page, r, k // 9")
def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14, LAY-01, SRC-05: the words of every page back to lines; a wide gap parts a line."""
    words = boxed_words(spark, sf_dir).select("doc_id", "page", "x0", "y0", "x1", "y1", "text")
    return L.lines(words, ["doc_id", "page"]).select("doc_id", "page", "x0", "y0", "text", "n", F.size("gaps").alias("gaps"))


@BOOK.add(f"""WITH {_WORDS} SELECT b.doc_id, page, count(*) AS words, min(text) AS first FROM b
WHERE (x0 + x1) / 2 BETWEEN 99 AND 101 + 10 * (doc_id % 30) AND (y0 + y1) / 2 BETWEEN 129 AND 201 GROUP BY ALL""")
def words_in_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-07, PRD-16, MAP-11: the words whose middle lies in the figure of their page, one box a page."""
    words = boxed_words(spark, sf_dir).withColumn("at", F.struct("doc_id", "page"))
    boxes = words.select("at").distinct().select("at", F.lit(100.0).alias("bx0"), F.lit(130.0).alias("by0"), (100.0 + 10 * (F.col("at.doc_id") % 30)).alias("bx1"), F.lit(200.0).alias("by1"))
    return L.inside(words, boxes, "at", 1.0).groupBy("doc_id", "page").agg(F.count("*").alias("words"), F.min("text").alias("first"))


_BOXED_LINES = _LINES + r""", b AS (SELECT doc_id, r // 50 AS page, r, CASE WHEN r % 4 = 3 THEN 350e0 ELSE 50e0 END AS x0, CASE WHEN r % 4 = 3 THEN 350e0 ELSE 50e0 END + least(320, 5 * length(line)) AS x1, 100e0 + 12 * (r % 50) AS y0, line FROM l WHERE trim(line) <> '')"""


@BOOK.add(f"""WITH {_BOXED_LINES} SELECT a.doc_id, a.page, CAST(a.r AS INTEGER) AS i, CAST(c.r AS INTEGER) AS below FROM b a JOIN b c ON c.doc_id = a.doc_id AND c.page = a.page AND c.r = a.r + 1
WHERE least(a.x1, c.x1) - greatest(a.x0, c.x0) > 0.5e0 * least(a.x1 - a.x0, c.x1 - c.x0)""")
def lines_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-20: the nearest line below in the same column; every fourth line is set aside to the right."""
    x0 = F.when(F.col("r") % 4 == 3, 350.0).otherwise(50.0)
    y0 = F.lit(100.0) + 12 * (F.col("r") % 50)
    lines = text_lines(spark, sf_dir).where(F.trim("line") != "")
    boxes = lines.select("doc_id", F.floor(F.col("r") / 50).cast("int").alias("page"), F.col("r").alias("i"), x0.alias("x0"), (x0 + F.least(F.lit(320), 5 * F.length("line"))).alias("x1"), y0.alias("y0"), (y0 + 10).alias("y1"))
    return L.next_lines(boxes, ["doc_id", "page"])


@BOOK.add(f"""WITH {_LINES}, b AS (SELECT doc_id, r // 56 AS page, r, 14 * (r % 56) AS y, regexp_replace(lower(line), '[^0-9a-z]', '', 'g') AS s, line FROM l),
e AS (SELECT *, regexp_replace(s, '\\d+', '#', 'g') AS key FROM b WHERE y < 64 OR y + 10 > 736), m AS (SELECT doc_id, key, count(*) AS m FROM e GROUP BY ALL)
SELECT e.doc_id, CAST(e.page AS INTEGER) AS page, CAST(e.r AS INTEGER) AS r FROM e JOIN m USING (doc_id, key) WHERE m >= 3 OR regexp_matches(s, '^(page)?\\d{{1,3}}(of\\d+)?$')""")
def running_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, PRD-20: running headers and page numbers among the lines at the edges of pages."""
    y = 14.0 * (F.col("r") % 56)
    blocks = text_lines(spark, sf_dir).select("doc_id", F.floor(F.col("r") / 56).cast("int").alias("page"), "r", y.alias("y0"), (y + 10).alias("y1"), F.col("line").alias("text"), F.lit(800.0).alias("h"))
    return L.running_edges(blocks, "doc_id", "h").select("doc_id", "page", "r")


_CAPTIONED = _LINES + """, c AS (SELECT doc_id, r // 50 AS page, r, CASE WHEN r % 10 = 3 THEN 'Figure ' || (r % 7) || ': ' || line WHEN r % 10 = 6 THEN 'TABLE ' || (r % 5) || '. ' || line WHEN r % 10 = 8 THEN 'see Table 1: ' || line ELSE line END AS text FROM l)"""


def captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, line = F.col("r"), F.col("line")
    text = F.when(r % 10 == 3, F.concat(F.lit("Figure "), r % 7, F.lit(": "), line)).when(r % 10 == 6, F.concat(F.lit("TABLE "), r % 5, F.lit(". "), line)).when(r % 10 == 8, F.concat(F.lit("see Table 1: "), line)).otherwise(line)
    return text_lines(spark, sf_dir).select("doc_id", F.floor(r / 50).cast("int").alias("page"), "r", text.alias("text"))


@BOOK.add(f"""WITH {_CAPTIONED}, f AS (SELECT doc_id, r, CASE WHEN starts_with(lower(text), 'tab') THEN 'Table ' ELSE 'Figure ' END || regexp_extract(text, '^(Figure|Fig\\.|Table|TABLE|FIGURE)\\s+(\\d+|[A-Z]\\d*)\\s*[:.]', 2) AS label, page FROM c WHERE regexp_matches(text, '^(Figure|Fig\\.|Table|TABLE|FIGURE)\\s+(\\d+|[A-Z]\\d*)\\s*[:.]'))
SELECT doc_id, label, CAST(arg_min(page, r) AS INTEGER) AS page, CAST(min(r) AS DOUBLE) AS y0 FROM f GROUP BY ALL""")
def caption_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-03: of each document the first line that begins as a caption of each figure or table; mentions don't count."""
    rows = captioned(spark, sf_dir).withColumns({"x0": F.lit(50.0), "y0": F.col("r").cast("double")})
    return L.captions(rows, ["page"], ("doc_id",)).select("doc_id", "label", "page", "y0")


@BOOK.add(f"""WITH {_CAPTIONED} SELECT doc_id, CAST(r AS INTEGER) AS r, CASE WHEN starts_with(lower(regexp_extract(text, '(?i)\\b(Fig(?:ure)?\\.?|Table)\\s*(\\d+)', 1)), 'tab') THEN 'Table ' ELSE 'Figure ' END || regexp_extract(text, '(?i)\\b(Fig(?:ure)?\\.?|Table)\\s*(\\d+)', 2) AS label
FROM c WHERE regexp_matches(text, '(?i)\\b(Fig(?:ure)?\\.?|Table)\\s*(\\d+)')""")
def figure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-09: the figure or table that a line names first."""
    return captioned(spark, sf_dir).select("doc_id", "r", T.figure_label(F.col("text")).alias("label")).where("label IS NOT NULL")


_CODE = " OR ".join("regexp_matches(line, '{}')".format(p.replace("'", "''")) for p in (*L.CODE.values(), L.ADDRESS, r"[a-z]-\s*$"))
_SIGNS = L.OPERATORS + L.GREEK
_MATH = ", ".join(f"'{w}'" for w in L.MATH_WORDS)
_SIGNED = _LINES + """, s AS (SELECT doc_id, r, CASE WHEN r % 3 = 0 THEN list_extract(string_split(line, ' '), 1) || ' = x ∑ y ' || (r % 9) WHEN r % 3 = 1 THEN 'if ' || line || ' ≤ 3' ELSE line END AS line FROM l)"""


@BOOK.add(f"""WITH {_SIGNED}, t AS (SELECT doc_id, r, line, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') AS w FROM s)
SELECT doc_id, CAST(r AS INTEGER) AS r, regexp_matches(line, '[{L.OPERATORS}]') AND NOT ({_CODE}) AND 2 * len(list_filter(w, lambda x: length(x) < 3 OR regexp_matches(x, '[{_SIGNS}]'))) >= len(w)
 AND len(list_filter(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z][a-z]{{3,}}[.,;:]?')), lambda x: lower(rtrim(x, '.,;:')) NOT IN ({_MATH}))) <= 3 AS formula FROM t""")
def formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-10: lines that are formulas; a third of the lines is made one, another third a condition with a sign."""
    r, line = F.col("r"), F.col("line")
    made = F.when(r % 3 == 0, F.concat(F.split(line, " ")[0], F.lit(" = x ∑ y "), r % 9)).when(r % 3 == 1, F.concat(F.lit("if "), line, F.lit(" ≤ 3"))).otherwise(line)
    return text_lines(spark, sf_dir).select("doc_id", "r", L.is_formula(made).alias("formula"))


_CLOSERS = "\"''”’)]"
_SHORT = ", ".join(f"'{a}'" for a in L.ABBREVIATIONS)
_ENDS = f"(right(bare, 1) IN ('?', '!') OR (right(bare, 1) = '.' AND lower(left(bare, -1)) NOT IN ({_SHORT}) AND NOT regexp_full_match(bare, '[A-Z]\\.')))"
_LISTED = r"regexp_full_match(bare, '\(?\d+[.)]')"


@BOOK.add(f"""WITH {_WORDS}, d AS (SELECT DISTINCT text AS word, rtrim(text, '{_CLOSERS}') AS bare FROM w) SELECT word, {_ENDS} AS sentence, {_ENDS} AND NOT {_LISTED} AS item FROM d""")
def sentence_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-06, PRD-07: which words of all documents end a sentence, in both readings."""
    words = text_lines(spark, sf_dir).select(F.explode(T.words(F.col("line"))).alias("word")).distinct()
    return words.select("word", L.ends_sentence(F.col("word")).alias("sentence"), L.ends_item(F.col("word")).alias("item"))


@BOOK.add(f"""WITH {_WORDS}, p AS (SELECT doc_id, r, k, CASE WHEN long THEN left(text, 4) || '-' ELSE text END AS a, CASE WHEN long THEN substr(text, 5) END AS c, k = n - 1 AS last FROM (SELECT *, length(text) >= 8 AND k % 5 = 0 AS long FROM w)),
q AS (SELECT doc_id, r, k, 0 AS part, a AS text, CASE WHEN c IS NULL THEN last ELSE TRUE END AS eol FROM p UNION ALL SELECT doc_id, r, k, 1, c, last FROM p WHERE c IS NOT NULL),
e AS (SELECT *, ({_ENDS}) AND NOT {_LISTED} AS ends FROM (SELECT *, rtrim(text, '{_CLOSERS}') AS bare FROM q)),
g AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY r, k, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM e),
t AS (SELECT doc_id, g, string_agg(text || CASE WHEN eol THEN chr(1) ELSE '' END, ' ' ORDER BY r, k, part) AS s FROM g GROUP BY ALL)
SELECT doc_id, CAST(g AS INTEGER) AS g, replace(regexp_replace(regexp_replace(s, '([^ ]*-[^ ]*-)\\x01 (\\p{{Ll}})', '\\1\\2', 'g'), '-\\x01 (\\p{{Ll}})', '\\1', 'g'), chr(1), '') AS text FROM t""")
def joined_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-10, TXT-11: the words of every document to sentences across lines; every fifth long word is broken, and joined again."""
    words = boxed_words(spark, sf_dir)
    long, last = (F.length("text") >= 8) & (F.col("k") % 5 == 0), F.col("k") == F.col("n") - 1
    broken = F.array(F.struct(F.concat(F.left("text", F.lit(4)), F.lit("-")).alias("w"), F.lit(True).alias("eol")), F.struct(F.substring("text", 5, 2**30).alias("w"), last.alias("eol")))
    parts = F.when(long, broken).otherwise(F.array(F.struct(F.col("text").alias("w"), last.alias("eol"))))
    rows = words.select("doc_id", "r", "k", F.posexplode(parts).alias("part", "p")).select("doc_id", F.struct("r", "k", "part").alias("pos"), "p.w", "p.eol")
    return L.joined_words(L.sentence_runs(rows, ["doc_id"], "pos"), ["doc_id", "g"], "pos")


@BOOK.add(f"""WITH {_WORDS}, n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY r, k) - 1) // 30 AS s FROM b),
g AS (SELECT doc_id, s, page, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM n GROUP BY ALL)
SELECT doc_id, CAST(s AS INTEGER) AS s, CAST(page AS INTEGER) AS page, x0, y0, x1, y1 FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, s ORDER BY n DESC, page) = 1""")
def sentence_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20, AGG-21: of every run of thirty words the page with most of them, and the union of their boxes there."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("r", "k")) - 1
    return L.dominant_page(boxed_words(spark, sf_dir).withColumn("s", F.floor(place / 30).cast("int")), ["doc_id", "s"])


@BOOK.add(f"""WITH {_WORDS}, g AS (SELECT doc_id, page, r, min(x0) AS x0, max(x1) AS x1, min(n) AS n, string_agg(text, ' ' ORDER BY k) AS text FROM b GROUP BY ALL),
t AS (SELECT doc_id, x1 - x0 AS typical FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY x1 - x0) = CAST(floor(count(*) OVER (PARTITION BY doc_id) * 0.75e0) AS BIGINT) + 1)
SELECT g.doc_id, CAST(r AS INTEGER) AS r, n >= 6 AND (x1 - x0 > 0.8e0 * typical OR regexp_matches(text, '[.:;)]$')) AS running FROM g JOIN t USING (doc_id)""")
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-09: lines of running text: wide enough for the page, or the end of a clause, from a margin on."""
    words = boxed_words(spark, sf_dir)
    lines = words.groupBy("doc_id", "r").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("n").alias("n"), F.max_by("text", "k").alias("text"))
    typical = L.at_quarter(lines.withColumn("width", F.col("x1") - F.col("x0")), ["doc_id"], "width")
    running = L.is_running_line(F.col("typical"), F.array(F.lit(50.0)), F.col("n"), F.col("x0"), F.col("x1"), F.col("text"))
    return lines.join(typical, "doc_id").select("doc_id", "r", running.alias("running"))


_PAPER = _LINES + r""", h AS (SELECT doc_id, r, CASE WHEN r % 23 = 20 THEN ' References ' WHEN r % 31 = 25 THEN 'Appendix' WHEN r % 6 = 2 THEN (r * 5 % 7 + 1) || CASE WHEN r % 4 = 0 THEN '.' || (r % 3 + 1) ELSE '' END || '  Part of ' || left(trim(line), 20)
 WHEN r % 17 = 9 THEN 'B Proofs' ELSE line END AS line FROM l),
m AS (SELECT *, trim(line) AS s, regexp_extract(line, '^\s{0,60}((?:\d{1,2}|[A-H])(?:\.\d{1,2}){0,2})\.?\s{1,16}((?:[A-Z]|[^\x00-\x7F])[^\n]{2,90})$', 1) AS num, trim(regexp_replace(regexp_extract(line, '^\s{0,60}((?:\d{1,2}|[A-H])(?:\.\d{1,2}){0,2})\.?\s{1,16}((?:[A-Z]|[^\x00-\x7F])[^\n]{2,90})$', 2), '\s+', ' ', 'g')) AS title FROM h),
n AS (SELECT doc_id, r, line, regexp_matches(s, '^(R\s?EFERENCES|References|REFERENCES|Bibliography)$') AS stops, bool_or(regexp_matches(s, '^A\s?PPENDIX|^Appendix$')) OVER (PARTITION BY doc_id ORDER BY r) AS late,
 CASE WHEN length(s) < 90 AND NOT suffix(s, '.') AND NOT regexp_matches(title, '\d{3,}') AND length(regexp_replace(title, '[^\p{L}]', '', 'g')) >= 3 AND len(list_filter(regexp_split_to_array(title, '\s+'), lambda x: x <> '')) <= 12 THEN num ELSE '' END AS num, title FROM m),
o AS (SELECT *, CASE WHEN regexp_matches(num, '^[0-9]') THEN CAST(split_part(num, '.', 1) AS INTEGER) END AS top FROM n),
p AS (SELECT *, stops OR (num <> '' AND (late OR top IS NULL OR coalesce(max(top) OVER (PARTITION BY doc_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= top)) AS starts FROM o),
q AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY r) AS section FROM p),
x AS (SELECT doc_id, section, coalesce(max(CASE WHEN starts THEN num END), '0') AS num, coalesce(max(CASE WHEN starts THEN title END), 'Front matter') AS title, coalesce(bool_or(starts AND stops), FALSE) AS stops, coalesce(bool_or(starts AND late), FALSE) AS late,
 trim(regexp_replace(string_agg(line, chr(10) ORDER BY r) FILTER (NOT starts), '[ \t]{2,}', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM q GROUP BY ALL),
y AS (SELECT *, last_value(CASE WHEN NOT stops AND NOT contains(num, '.') THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section) AS parent, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda v: v <> '')) AS words FROM x)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with headings, some of which go backwards, references and appendices among them."""
    r, line = F.col("r"), F.col("line")
    number = F.concat(r * 5 % 7 + 1, F.when(r % 4 == 0, F.concat(F.lit("."), r % 3 + 1)).otherwise(""))
    made = F.when(r % 23 == 20, " References ").when(r % 31 == 25, "Appendix").when(r % 6 == 2, F.concat(number, F.lit("  Part of "), F.left(F.trim(line), F.lit(20)))).when(r % 17 == 9, "B Proofs").otherwise(line)
    return text_lines(spark, sf_dir).select("doc_id", "r", made.alias("line"))


@BOOK.add(f"WITH {_PAPER} SELECT doc_id, CAST(section AS BIGINT) AS section, num, title, coalesce(parent, 'Front matter') AS parent, late OR NOT regexp_matches(num, '^[0-9]') AS appendix, CAST(words AS BIGINT) AS words, text FROM y WHERE NOT stops AND words >= 25")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-02, WIN-08: the numbered sections of every document; numbers only move forward, references go."""
    return S.split(papers(spark, sf_dir), "doc_id", "r")


@BOOK.add(f"""WITH {_PAPER}, z AS (SELECT *, NOT stops AND words >= 25 AS kept FROM y), k AS (SELECT * FROM z WHERE kept),
c AS (SELECT doc_id, section, num, num <> coalesce(lag(num) OVER (PARTITION BY doc_id ORDER BY section), '') AS fresh FROM k)
SELECT doc_id, count(*) FILTER (fresh) AS sections, string_agg(num, ' ' ORDER BY section) FILTER (fresh) AS numbers FROM c GROUP BY doc_id""")
def folded_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07: neighbours with one number become one section; what is left has no two in a row."""
    folded = S.folded(S.split(papers(spark, sf_dir), "doc_id", "r"), "doc_id")
    order = F.sort_array(F.collect_list(F.struct("section", "num")))
    return folded.groupBy("doc_id").agg(F.count("*").alias("sections"), F.array_join(F.transform(order, lambda x: x["num"]), " ").alias("numbers"))


@BOOK.add(f"""WITH {_PAPER}, k AS (SELECT doc_id, section, words FROM y WHERE NOT stops AND words >= 25), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, section) AS rank FROM k)
SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section) AS INTEGER) AS place FROM t WHERE rank <= 4""")
def richest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-04: the four sections of each document that say most, in the paper's order."""
    return S.richest(S.split(papers(spark, sf_dir), "doc_id", "r"), "doc_id", "section", "words", F.lit(4)).select("doc_id", "section", "place")


@BOOK.add(f"WITH {_LINES} SELECT doc_id, CAST(r AS INTEGER) AS r, regexp_matches(line, '{O.LIMITATION}') AS limits FROM l")
def limitation_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-04: lines that would be titles of limitations."""
    return text_lines(spark, sf_dir).select("doc_id", "r", O.is_limitation(F.col("line")).alias("limits"))


@BOOK.add(f"""WITH {_LINES}, t AS (SELECT doc_id, r, trim(regexp_replace(CASE WHEN r % 2 = 0 THEN upper(line) || ' (part ' || r || ')' ELSE line END, '\\s*\\(part \\d+\\)$', '')) AS t FROM l WHERE regexp_full_match(line, '[A-Za-z ,.]+')),
s AS (SELECT doc_id, r, regexp_replace(t, '\\s+', ' ', 'g') AS t FROM t), i AS (SELECT doc_id, r, CASE WHEN t = upper(t) THEN array_to_string(list_transform(string_split(lower(t), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') ELSE t END AS t FROM s)
SELECT doc_id, CAST(r AS INTEGER) AS r, CASE WHEN length(t) <= 60 THEN t ELSE regexp_replace(left(t, 57), ' [^ ]*$', '') || '...' END AS title FROM i""")
def chapter_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-10: lines of letters as chapter titles, every second one in capitals with a part."""
    lines = text_lines(spark, sf_dir).where(F.col("line").rlike(r"^[A-Za-z ,.]+$"))
    made = F.when(F.col("r") % 2 == 0, F.concat(F.upper("line"), F.lit(" (part "), F.col("r"), F.lit(")"))).otherwise(F.col("line"))
    return lines.select("doc_id", "r", S.short_title(made).alias("title"))


@BOOK.add(f"""WITH {_BOXED_LINES}, g AS (SELECT *, y0 + 10 AS y1, CASE WHEN y0 - lag(y0 + 10) OVER w BETWEEN 0 AND 4.9 THEN 0 ELSE 1 END AS begins FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY r)),
n AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, page ORDER BY r) AS run FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, run ORDER BY r) AS k FROM n),
p AS (SELECT a.doc_id, a.r, a.k AS own, c.k, c.x0, c.y0, c.x1, c.y1, abs(c.x0 - a.x0) >= 40 AS aside FROM k a JOIN k c ON c.doc_id = a.doc_id AND c.page = a.page AND c.run = a.run AND c.k BETWEEN a.k - 6 AND a.k + 6),
m AS (SELECT doc_id, r, coalesce(max(CASE WHEN aside AND k < own THEN k END), -1) AS lo, coalesce(min(CASE WHEN aside AND k > own THEN k END), 1000000000) AS hi FROM p GROUP BY ALL)
SELECT p.doc_id, CAST(p.r AS INTEGER) AS r, min(x0) AS px0, min(y0) AS py0, max(x1) AS px1, max(y1) AS py1 FROM p JOIN m ON m.doc_id = p.doc_id AND m.r = p.r WHERE k > lo AND k < hi GROUP BY p.doc_id, p.r""")
def paragraph_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-11: the box of each line's paragraph; empty lines and lines set aside end one."""
    r = F.col("r")
    x0, y0 = F.when(r % 4 == 3, 350.0).otherwise(50.0), F.lit(100.0) + 12 * (r % 50)
    lines = text_lines(spark, sf_dir).where(F.trim("line") != "")
    boxes = lines.select("doc_id", F.floor(r / 50).cast("int").alias("page"), "r", x0.alias("x0"), (x0 + F.least(F.lit(320), 5 * F.length("line"))).alias("x1"), y0.alias("y0"), (y0 + 10).alias("y1"))
    return L.paragraphs(boxes, ["doc_id", "page"], "r").select("doc_id", "r", "px0", "py0", "px1", "py1")
