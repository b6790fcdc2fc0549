"""Readers: jobs and their documents as typed tables, LaTeX trees, and recorded answers of tools outside Spark.

Every reader goes through Spark's own file sources, so any storage that Spark reads will do. Tools that Spark can't run
(page rasterisers, voices, language models, networks) are boundaries: their recorded answers are tables with these schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
#: Schemas of the JSON documents of a job; unknown fields are ignored, missing ones are null.
SCHEMAS = {
    "state": "id string, name string, created double, error string, settings map<string,string>, outputs map<string,string>, license_stop string, "
    "stages map<string,struct<label:string,status:string,progress:double,msg:string,started:double,ended:double>>",
    "doc": "pages int, pdf_title string, license string, arxiv string, first_page string, sections array<struct<num:string,title:string,parent:string,appendix:boolean,text:string,words:int>>",
    "chunks": "title string, parent string, appendix boolean, text string",
    "index": f"page int, box {BOX}, text string, toks array<string>, words array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>",
    "figs": f"id string, label string, kind string, page int, box {BOX}, caption string, caption_box {BOX}, file string",
    "notes": "title string, parent string, appendix boolean, words int, summary string, error string, key_numbers array<struct<value:string,meaning:string>>, "
    "claims array<string>, method array<string>, limitations array<string>, figures array<string>",
    "script": "meta map<string,string>, chapters array<struct<key:string,title:string,sentences:array<struct<text:string,spoken:string,figure:string,status:string,pause:double>>>>, source string, model string",
    "quiz": "questions array<struct<question:string,options:array<string>,answer:int,kind:string,explanation:string>>, rejected array<struct<question:string,why:string>>",
    "playlists": "playlists array<struct<id:string,name:string,depth:string,order:string,created:double,items:array<struct<key:string,arxiv:string,title:string,published:string,status:string,added:double,job:string,license:string,allowed:boolean>>>>",
    "answers": "key string, answer string",
    "durations": "id string, seconds double",
    "records": "arxiv string, version string, title string, authors array<string>, published string, updated string, comment string, journal_ref string, doi string, category string, abstract string",
    "processes": "name string, pid int, gb double",
    "models": "name string, gb double, vision boolean, loaded boolean",
}


def documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON documents of one kind under ``path`` (one for each folder), with ``job``: the folder they lie in.

    Malformed documents give a row of nulls with their text in ``_corrupt``; a reader that skips them filters on it.
    """
    raw = spark.read.format("json").schema(SCHEMAS[kind] + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True)
    rows = raw.option("recursiveFileLookup", True).option("pathGlobFilter", f"{kind}.json").load(path)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("job"))


def newest_jobs(states: DataFrame) -> DataFrame:
    """Readable jobs, newest first: identifiers begin with a time."""
    return states.where("_corrupt IS NULL AND id IS NOT NULL").orderBy(F.desc("id"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of files that begin as a PDF does; the content stays where it is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.substring("content", 1, 4) == F.lit(b"%PDF")).select("path", "length")


def latex_documents(spark: SparkSession, path: str) -> DataFrame:
    """(paper, source): the flattened LaTeX of each folder under ``path``. A group is the text files of one paper."""
    from vellumspark.functions import latex

    import pandas as pd

    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tex,sty,cls,bbl,def,ltx}").load(path)
    root = path.rstrip("/").rpartition("/")[2]
    rel = F.regexp_extract("_metadata.file_path", rf"/{root}/(.+)$", 1)
    each = files.select(F.substring_index(rel, "/", 1).alias("paper"), F.regexp_extract(rel, r"^[^/]+/(.+)$", 1).alias("file"), F.col("value").alias("text"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"paper": [group["paper"].iloc[0]], "source": [latex.flattened(dict(zip(group["file"], group["text"])))]})

    return each.groupBy("paper").applyInPandas(run, "paper string, source string")


def feed(spark: SparkSession, xml: DataFrame, column: str) -> DataFrame:
    """Entries of recorded Atom answers: unknown identifiers and errors dropped, white space collapsed, dates cut to days."""
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    entries = xml.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("e"))
    tag = lambda name: squeeze(F.regexp_extract("e", rf"(?s)<(?:\w+:)?{name}[^>]*>(.*?)</(?:\w+:)?{name}>", 1))
    full = F.regexp_extract(tag("id"), r"/abs/(.+)$", 1)
    names = F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<name>(.*?)</name>"), F.lit(1)), squeeze)
    rows = entries.select(
        F.regexp_replace(full, r"v\d+$", "").alias("preprint"), F.regexp_extract(full, r"(v\d+)$", 1).alias("version"), tag("title").alias("title"), names.alias("authors"),
        F.substring(tag("published"), 1, 10).alias("published"), tag("comment").alias("comment"), tag("journal_ref").alias("journal_ref"),
    )
    return rows.where((F.col("preprint") != "") & (F.lower("title") != "error"))


def top_processes(rows: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """(name, gb): the k largest by name, of those ``least`` GB or more."""
    sums = rows.groupBy("name").agg(F.sum("gb").alias("gb"))
    return sums.orderBy(F.desc("gb"), "name").limit(k).where(F.col("gb") >= least)
