"""What the operators of this subpackage share: reading tables, shared storage, hot keys."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes translation that lower-cases A-Z only.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Keys that :func:`join_hot` broadcasts: a constant, so the broadcast side is bounded at any size.
HOT_KEYS = 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that no extra column can clash; a null text is the empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of our own only where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    own = tempfile.mkdtemp(prefix="vellumspark-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


#: Folders of this process' applications, which go when it ends.
_FOLDERS: set[str] = set()


def _free(spark: SparkSession, folder: str, configuration) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        at.getFileSystem(configuration).delete(at, True)
    except Exception:  # the virtual machine may be gone by then, and its files with it
        pass


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one. What an application keeps stays until its driver ends: results are lazy."""
    folder = f"{shared_dir(spark)}/vellumspark/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_free, spark, folder, spark._jsc.hadoopConfiguration())
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage is cut, and a lost executor loses nothing."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def store(df: DataFrame, label: str) -> DataFrame:
    return stored(df, label)[0]


def sweep(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` (many for each key) with ``groups`` (one row for each key, ``size`` counts its rows).

    The HOT_KEYS largest groups are broadcast and their rows stay where they are; the rest, none of which can hold
    more than 1/HOT_KEYS of all rows, is joined by a shuffle. ``rows`` is read twice: pass a stored frame.
    """
    hot = groups.where(F.col(size) > 1).orderBy(F.col(size).desc(), F.col(key)).limit(HOT_KEYS)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups, key, how)
    return near.unionByName(far)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as it takes to be no column of ``df``, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keep_named(docs: DataFrame, names: DataFrame, text: Column) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, SHA-256 of ``text``) is among ``names`` (doc_id, sha), one for each name.

    Rows that repeat a name are reduced by an aggregation that needs no exchange beyond that of the join: the one with
    the smallest hash of all its columns stays, so a rerun keeps the same.
    """
    i, s, row, least = (free_name(docs, n) for n in ("i", "s", "row", "least"))
    names = names.select(F.col("doc_id").alias(i), F.col("sha").alias(s))
    plain = lambda c: F.to_json(F.struct(c)) if docs.schema[c].dataType.typeName() in ("map", "struct", "array", "variant") else F.col(f"`{c}`")
    each = F.xxhash64("text", *(plain(c) for c in docs.columns))
    named = docs.select(F.col("doc_id").alias(i), F.unhex(F.sha2(text, 256)).alias(s), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), each.alias(least))
    on = named[i].eqNullSafe(names[i]) & (named[s] == names[s])
    kept = named.join(names, on, "left_semi").groupBy(i, s).agg(F.min_by(row, least).alias(row))
    return kept.select(f"{row}.*")


def word_bounds(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of ``raw`` (separated by ASCII white space) joined by single blanks, and where each begins and ends.

    Three arrays the size of the text, but no object for a word: a very long text costs a small multiple of itself.
    """
    data = np.frombuffer(raw, np.uint8)
    letter = (data > 32) | (data < 9) | ((data > 13) & (data < 32))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]]).astype(np.int8)))
    lengths = edges[1::2] - edges[::2]
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    kept = letter.copy()
    kept[edges[1:-1:2]] = True  # one separator behind every word but the last
    joined = data[kept]
    joined[ends[:-1]] = 32
    return joined.tobytes(), starts, ends


def give_back() -> None:
    """Return a Python worker's free memory to the system, so that it doesn't add up over the stages it serves."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
