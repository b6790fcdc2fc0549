"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: one record per page. Pages with equal payloads (SHA-1 of the UTF-8 bytes) form a group; its largest page_id is
written as response, the others as revisit records without payload. Groups are counted on digests alone; the payload
crosses the network once, and the largest groups are looked up in a broadcast table of fixed size. Spark's text writer
with the record separator CRLF CRLF writes the (gzip) archives, so any storage of Spark's will do.

Reading: tasks emit a candidate (offset -> successor offset) for each "WARC/1.x" magic, wherever it stands; then pointer
jumping from offset 0 keeps only records that are reachable, in a logarithmic number of rounds for each archive, which
rejects magic inside payloads. Digests are computed again from the stored bytes.

Defined results: null html or url counts as empty; equal empty payloads are a group too; a null page_id is written and
read back as null, and is a revisit where the group has another id; rows that repeat both page_id and payload give a
record each, and those with the group's largest id are all responses; an empty table gives an empty result; extra columns
are ignored. A truncated archive yields the records before the damage.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm.common import HOT_KEYS, new_folder, store

#: Bytes that an archive holds before the next one is begun, about.
ARCHIVE_BYTES = 32 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PAGE = "urn:page:"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a digest of 40 hex digits: five digits at a time are four letters."""
    letters = []
    for k in range(8):
        part = F.conv(F.substring(hex_digest, 1 + 5 * k, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_ALPHABET), F.shiftright(part, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame) -> DataFrame:
    """One column ``value``: the text of every record, without the separator."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("d", F.unhex(F.sha1(F.col("html").cast("binary"))))
    groups = store(rows.groupBy("d").agg(F.max("page_id").alias("m"), F.count("*").alias("n")).where("n > 1"), "warc-groups")
    hot = groups.orderBy(F.desc("n"), "d").limit(HOT_KEYS).select("d", F.col("m").alias("hot_m"), F.lit(True).alias("hot"))
    # a row that found its group already gets a key of its own, so that no key gathers such rows
    key = F.when(F.col("hot").isNull(), F.col("d")).otherwise(F.unhex(F.sha1(F.concat(F.lit("hot"), F.col("page_id").cast("string")).cast("binary"))))
    marked = rows.join(F.broadcast(hot), "d", "left").withColumn("k", key)
    found = marked.join(groups.select(F.col("d").alias("k"), F.col("m").alias("far_m")), "k", "left")
    found = found.withColumn("m", F.coalesce("hot_m", "far_m"))
    revisit = F.col("m").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("m"))
    body = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    urn = lambda c: F.concat(F.lit(f"<{PAGE}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    lines = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        urn(F.col("page_id")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.regexp_replace("url", r"[\x00-\x20]", "%20"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        base32(F.hex("d")),
        F.lit("\r\nX-Payload-Length: "),
        F.octet_length("html").cast("string"),
        F.when(
            revisit,
            F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("m"))),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return found.select(F.concat(lines, body).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Write the archives under ``path``."""
    size = pages.agg(F.avg(F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0))).alias("a")).first()["a"] or 0
    out = records(pages).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    out.option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / (size + 500)))).text(path)


def _candidates(data: bytes) -> Iterator[tuple]:
    """(offset, successor, type, id, refers_to, digest, length, payload start, end) of whatever looks like a record."""
    for m in _MAGIC.finditer(data):
        head = data.find(b"\r\n\r\n", m.end())
        if head < 0:
            continue
        fields = dict(line.partition(b": ")[::2] for line in data[m.end() : head].split(b"\r\n"))
        length = fields.get(b"Content-Length", b"")
        if not length.isdigit():
            continue
        end = head + 4 + int(length)
        if data[end : end + 4] != b"\r\n\r\n":
            continue
        start = data.find(b"\r\n\r\n", head + 4, end)
        yield m.start(), end + 4, fields, (start + 4 if start >= 0 else end), end


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row for each candidate of each archive under ``path``."""

    def page(value: bytes | None) -> int | None:
        found = re.fullmatch(rf"<{PAGE}(-?\d+)>".encode(), value or b"")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                raw = batch.column(1)[at].as_py()
                data = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
                rows = []
                for offset, successor, fields, start, end in _candidates(data):
                    kind = fields.get(b"WARC-Type", b"").decode("latin-1")
                    stated = fields.get(b"WARC-Payload-Digest", b"").decode("latin-1").removeprefix("sha1:")
                    payload = data[start:end]
                    if kind == "revisit":
                        digest, n = stated, int(fields.get(b"X-Payload-Length", b"-1"))
                    else:
                        digest, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                    rows.append((offset, successor, len(data), page(fields.get(b"WARC-Record-ID")), n, digest, kind, page(fields.get(b"WARC-Refers-To")), digest == stated))
                if rows:
                    names = ["archive", "at", "successor", "size", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
                    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64(), pa.bool_()]
                    columns = [pa.array([batch.column(0)[at].as_py()] * len(rows), pa.string()), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(
        run, "archive string, at long, successor long, size long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
    )


def reachable(at: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which of the offsets ``at`` (ascending) a walk from offset 0 over successors meets, by pointer jumping."""
    n = len(at)
    index = np.searchsorted(at, successor)
    found = (index < n) & (at[np.minimum(index, n - 1)] == successor)
    jump = np.append(np.where(found, index, n), n)  # n: the end, or nowhere
    reached = np.zeros(n + 1, bool)
    reached[:n] = at == 0
    for _ in range(max(1, int(n).bit_length())):
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached[:n]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``. The group of a task is the candidates of one archive, without payloads."""

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at", ignore_index=True)
        return group[reachable(group["at"].to_numpy(), group["successor"].to_numpy())]

    found = candidates(spark, path)
    return found.groupBy("archive").applyInPandas(chain, found.schema)


def contract(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives."""
    spark, path = pages.sparkSession, new_folder(pages.sparkSession, "warc")
    write(pages, path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
