"""Sources, sinks and the streaming extension, on folders written for the query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.plans.base import Book
from vellumspark.sources import readers, sinks

BOOK = Book()


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names; a temporary one only where none is named."""
    import tempfile

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/vellumspark-plans/{uuid.uuid4().hex}"


@BOOK.add("""SELECT * FROM (VALUES ('2026-2', 'B', 0.75e0, false), ('2026-1', 'A', 1.0e0, true)) AS t(id, name, progress, finished)""")
def job_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14, SRC-15, SNK-02, JON-12: job documents written and scanned; unreadable ones are skipped."""
    from vellumspark.operators import library

    path = _folder(spark)
    docs = spark.createDataFrame(
        [
            ("2026-1", '{"id": "2026-1", "name": "A", "stages": {"parse": {"status": "done"}, "quiz": {"status": "skipped"}}}'),
            ("2026-2", '{"id": "2026-2", "name": "B", "stages": {"parse": {"status": "done"}, "quiz": {"status": "running", "progress": 0.5}}}'),
            ("2026-3", '{"id": '),
        ],
        "job string, value string",
    )
    docs.repartition(3, "job").write.partitionBy("job").text(path)
    rows = spark.read.option("wholetext", True).text(path).select(F.from_json("value", readers.SCHEMAS["state"]).alias("s")).select("s.*").where("id IS NOT NULL")
    stages = rows.select("id", "name", F.explode("stages").alias("key", "stage")).select("id", "name", "stage.status", "stage.progress")
    return library.stage_progress(stages, "id").join(rows.select("id", "name"), "id").select("id", "name", "progress", "finished")


@BOOK.add("""SELECT * FROM (VALUES ('2310.06770', 'v2', 'A Title', 'Jane Roe,Wei Li', '2023-10-10', 'ICLR 2024')) AS t(preprint, version, title, authors, published, comment)""")
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07: entries of a recorded answer; errors and unknown identifiers are dropped."""
    xml = (
        "<feed><entry><id>http://arxiv.org/abs/2310.06770v2</id><title>A\n  Title</title><author><name>Jane  Roe</name></author><author><name>Wei Li</name></author>"
        "<published>2023-10-10T16:00:00Z</published><arxiv:comment>ICLR 2024</arxiv:comment></entry><entry><id>http://arxiv.org/api/errors</id><title>Error</title></entry></feed>"
    )
    rows = readers.feed(spark, spark.createDataFrame([(xml,)], "xml string"), "xml")
    return rows.select("preprint", "version", "title", F.array_join("authors", ",").alias("authors"), "published", "comment")


@BOOK.add("""SELECT * FROM (VALUES ('a', 3.5e0), ('b', 0.4e0)) AS t(name, gb)""")
def top_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18: memory by name, the largest few."""
    return readers.top_processes(spark.sql("SELECT * FROM (VALUES ('a', 1, 3.0D), ('b', 2, 0.4D), ('a', 3, 0.5D), ('c', 4, 0.2D)) AS t(name, pid, gb)"))


@BOOK.add("""SELECT * FROM (VALUES ('p', 1, true), ('q', 0, true)) AS t(paper, equations, prose)""")
def latex_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10, SRC-12, SRC-13: source trees flattened: main file, inclusions once, comments out."""
    from vellumspark.functions import latex

    files = {
        "p": {"main.tex": "\\documentclass{a}\\begin{document}We go. \\input{sec/one} % no \\input{x}\n\\input{sec/one}\\end{document}", "sec/one.tex": "\\begin{equation}a=1\\end{equation}", "other.tex": "x"},
        "q": {"a.tex": "\\documentclass{a}\\begin{document}Only prose.\\end{document}"},
    }
    rows = spark.createDataFrame([(k, f, t) for k, v in files.items() for f, t in v.items()], "paper string, file string, text string")

    def run(group):
        import pandas as pd

        source = latex.flattened(dict(zip(group["file"], group["text"])))
        return pd.DataFrame({"paper": [group["paper"].iloc[0]], "equations": [len(latex.equations(source))], "prose": ["document" in source]})

    return rows.groupBy("paper").applyInPandas(run, "paper string, equations int, prose boolean")


@BOOK.add("""SELECT * FROM (VALUES ('v', '1' || chr(10) || '00:00:00,500 --> 00:00:02,000' || chr(10) || 'Hello.' || chr(10) || chr(10) || '2' || chr(10) || '00:00:02,000 --> 00:00:03,250' || chr(10) || 'World.' || chr(10))) AS t(video, text)""")
def subtitle_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03: cues as a subtitle file."""
    rows = spark.sql("SELECT * FROM (VALUES ('v', 2, 2.0D, 3.25D, 'World.'), ('v', 1, 0.5D, 2.0D, 'Hello.')) AS t(video, pos, t0, t1, text)")
    return sinks.subtitles(rows, "video", ["pos"])


@BOOK.add("""SELECT * FROM (VALUES ('Paper', '.mp4', 'Paper (3).mp4'), ('New', '.mp4', 'New.mp4')) AS t(stem, extension, name)""")
def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07: names that overwrite nobody else's file."""
    wanted = spark.sql("SELECT * FROM (VALUES ('Paper', '.mp4'), ('New', '.mp4')) AS t(stem, extension)")
    return sinks.undisturbed(wanted, spark.sql("SELECT * FROM (VALUES ('Paper.mp4'), ('Paper (2).mp4'), ('Other.mp4')) AS t(name)"))


