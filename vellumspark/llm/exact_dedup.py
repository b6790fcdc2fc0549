"""Exact deduplication by a 128-bit content hash, smallest id stays, bytes compared inside groups.

Native: DataFrame functions only. Texts never meet in one task: groups are counted on 16-byte hashes, and only texts
whose hash occurs more than once are compared, by grouping on the text itself, which collapses copies map-side. A bitmap
of fixed size tells in place which texts may be such; where it fills up, more texts are compared and nothing is lost.

Defined results: null text counts as empty; texts that differ in white-space runs alone are equal; a null doc_id is
larger than any other; of rows that repeat both id and text exactly one is kept; an empty table gives an empty one;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import SPACE, join_hot, keep_named, store, texts

#: Hex digits of a hash that name its bit in the broadcast bitmap: 2**24 bits in 2**18 words, whatever the input's size.
SLOT_DIGITS = 6


def normalised(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("norm", F.regexp_replace("text", SPACE, " "))


def groups_of(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, uid, text_sha256, keep_id, group_size, kept."""
    keyed = normalised(docs).select(
        "doc_id", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")
    )
    sig = store(keyed.withColumn("uid", F.monotonically_increasing_id()), "exact-signatures")
    first = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("o"), "uid", "doc_id")
    by_hash = sig.groupBy("h").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    repeated = store(by_hash.where("n > 1"), "exact-repeated")
    # Bytes are compared inside each group: one variant means that all its texts are the same.
    # Only texts whose hash may be a repeated one leave their task; a text let through by chance is a variant by itself.
    slot = F.conv(F.substring(F.hex("h"), 1, SLOT_DIGITS), 16, 10).cast("long")
    words = repeated.select(slot.alias("slot")).groupBy(F.expr("slot >> 6").alias("word"))
    bitmap = words.agg(F.expr("bit_or(1L << CAST(slot & 63 AS INT))").alias("bits"))
    variants = (
        normalised(docs)
        .select(F.unhex(F.md5("norm")).alias("h"), "norm")
        .withColumn("slot", slot)
        .withColumn("word", F.expr("slot >> 6"))
        .join(F.broadcast(bitmap), "word")
        .where("(bits >> CAST(slot & 63 AS INT)) & 1 = 1")
        .groupBy("h", "norm")
        .agg(F.count("*").alias("m"))
    )
    collided = variants.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h")
    collided = store(collided, "exact-collisions")
    if collided.isEmpty():
        split = sig.withColumn("g", F.col("h"))
    else:  # a group of different texts is split by SHA-256, so unequal bytes never share a group
        marked = sig.join(collided.withColumn("c", F.lit(True)), "h", "left")
        split = store(marked.withColumn("g", F.when(F.col("c"), F.concat("h", "sha")).otherwise(F.col("h"))).drop("c"), "exact-split")
        repeated = split.groupBy("g").agg(F.count("*").alias("n"), F.min(first).alias("first")).where("n > 1").withColumnRenamed("g", "h")
    # Rows of the largest groups find theirs in a broadcast table and stay in place; the others are joined by a shuffle,
    # in which no group is large. A row without a repeated hash is its own group.
    found = join_hot(split, repeated.withColumnRenamed("h", "g"), "g", "n", "left")
    alone = F.col("n").isNull()
    return found.select(
        "doc_id",
        "uid",
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("first.uid"))).alias("kept"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    return groups_of(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are named by id and SHA-256 of the normalised text; of rows that repeat both, one is left.
    """
    verdict = store(groups_of(docs), "exact-verdict")
    names = verdict.where("kept").select("doc_id", F.unhex("text_sha256").alias("sha"))
    return keep_named(docs, names, F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
