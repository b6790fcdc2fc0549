"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is eight (position, byte) postings. Two fingerprints that differ in at most four bits differ in at most
four bytes, so they share at least LEAST_SHARED postings: the guaranteed minimum. Posting lists of single bytes would
grow with the table, so the index is keyed by three postings at once. A pair is met under its three lowest shared
positions, its tally of shared positional bytes is taken there, pairs under the minimum are dropped, the rest verified
by the Hamming distance. Lists longer than LONG are split by a further byte and, where still longer, by a slice of the
other bits: pairs that qualify share such a byte (the minimum) and such a slice (five slices, four differing bits), so
splitting loses none. Within such a list, members near its most central one hang on that; only the others are compared.

Defined results: null text counts as empty; a text without words has fingerprint zero; fewer words than a shingle give
one shingle; copies share a fingerprint and are indexed once, whatever their ids; rows without a doc_id are fingerprinted
and grouped, and name a group only where it has no other row; very long texts are hashed in steps of bounded size; an
empty table gives an empty one; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import LOWER, give_back, join_hot, store, texts, word_bounds
from vellumspark.llm.components import components

#: Bits of a fingerprint that may differ, and the bytes that two such fingerprints share at least.
MAX_BITS = 4
LEAST_SHARED = 8 - MAX_BITS
SEED = 42
#: Shingles hashed at a time: bounds memory for very long texts.
STEP = 1 << 16
#: Entries of a posting list that are compared pair by pair; longer lists are split.
LONG = 64


def fingerprint(text: str, words: int) -> int:
    """Majority vote over the bits of the XXH64 of all shingles of ``words`` words, as a signed 64-bit integer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    joined, starts, ends = word_bounds(text.encode("utf-8", "surrogatepass").translate(LOWER))
    if not len(starts):
        return 0
    k = min(words, len(starts))
    starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), STEP):
        hashed = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist())], ">u8")
        votes += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])
        give_back()

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _byte(column: str | Column, position: int | Column) -> Column:
    if isinstance(position, int):
        return F.shiftrightunsigned(column, 8 * position).bitwiseAND(255)
    return F.call_function("shiftrightunsigned", F.col(column), position.cast("int") * 8).bitwiseAND(255)


def _digit(packed: Column, k: int) -> Column:
    return F.shiftrightunsigned(packed, 4 * k).bitwiseAND(15)


def _keys(choices: list[tuple[int, ...]]) -> Column:
    """Keys of posting lists, one for each choice of positions: the positions (4 bits each), then their bytes of ``fp``.

    A lambda over the choices: written out, they were thousands of expressions, which the driver planned and kept.
    """
    n = len(choices[0])
    packed = F.array(*(F.lit(sum(p << 4 * (n - 1 - k) for k, p in enumerate(c))) for c in choices))

    def key(c: Column) -> Column:
        found = c.cast("long")
        for k in reversed(range(n)):
            found = F.shiftleft(found, 8).bitwiseOR(_byte("fp", _digit(c, k)))
        return found

    return F.transform(packed, key)


def _further() -> Column:
    """The keys of three positions (``key``) with each later position added."""
    positions, found = F.shiftrightunsigned("key", 24), F.col("key").bitwiseAND((1 << 24) - 1)
    with_byte = lambda p: F.shiftleft(F.shiftleft(positions, 4).bitwiseOR(p), 32).bitwiseOR(F.shiftleft(found, 8)).bitwiseOR(_byte("fp", p))
    return F.transform(F.sequence(_digit(positions, 0).cast("int") + 1, F.lit(7)), with_byte)


def _verified(pairs: DataFrame, depth: int) -> DataFrame:
    """Count filter, distance, and the ``depth`` lowest shared positions being those of the key, which makes a pair unique."""
    differ = F.col("a").bitwiseXOR(F.col("b"))
    shared = [_byte(differ, p) == 0 for p in range(8)]
    tally = sum((s.cast("int") for s in shared[1:]), shared[0].cast("int"))
    met = [F.shiftrightunsigned("key", 8 * depth + 4 * (depth - 1 - k)).bitwiseAND(15) for k in range(depth)]
    lowest = F.lit(True)
    for p in range(8):  # a shared position at or below the key's last one is one of the key's
        lowest = lowest & (~shared[p] | (F.lit(p) > met[-1]) | sum(((m == p).cast("int") for m in met[1:]), (met[0] == p).cast("int")).cast("boolean"))
    return pairs.where((tally >= LEAST_SHARED) & (F.bit_count(differ) <= MAX_BITS) & lowest)


def _paired(listed: DataFrame, on: list[str]) -> DataFrame:
    """Pairs a < b of each list. The lists have been exploded, which size estimates don't know of: never broadcast."""
    left, right = listed.withColumnRenamed("fp", "a"), listed.select(*on, F.col("fp").alias("b"))
    return left.hint("merge").join(right, on).where(F.col("a") < F.col("b"))


def _slices() -> Column:
    """The bits of ``fp`` outside the four positions of ``key``, 32 of them, as MAX_BITS + 1 numbered slices: one at least is equal in a pair."""
    positions = F.shiftrightunsigned("key", 32)
    taken = lambda p: (_digit(positions, 0) == p) | (_digit(positions, 1) == p) | (_digit(positions, 2) == p) | (_digit(positions, 3) == p)
    add = lambda rest, p: F.when(taken(p), rest).otherwise(F.shiftleft(rest, 8).bitwiseOR(_byte("fp", p)))
    rest = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), add)
    cuts = [round(32 * k / (MAX_BITS + 1)) for k in range(MAX_BITS + 2)]
    cut = lambda k, a, b: F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit((1 << b - a) - 1).alias("mask"))
    bounds = F.array(*(cut(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))))
    number = lambda c: F.shiftleft(c["k"].cast("long"), 8).bitwiseOR(F.call_function("shiftrightunsigned", rest, c["a"]).bitwiseAND(c["mask"]))
    return F.transform(bounds, number)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints (fp): two within MAX_BITS of each other are joined directly, or both
    to one fingerprint that is within MAX_BITS of either; no other link is made."""
    # a pair that shares four positions has its lowest three among the first seven
    first = list(combinations(range(7), LEAST_SHARED - 1))
    index = distinct.select("fp", F.explode(_keys(first)).alias("key"))
    sized = lambda df, *on: df.withColumn("n", F.count("*").over(Window.partitionBy(*on))).where("n > 1")
    index = store(sized(index, "key"), "simhash-index")
    short = _verified(_paired(index.where(F.col("n") <= LONG).select("fp", "key"), ["key"]), 3)

    deeper = index.where(F.col("n") > LONG).select("fp", F.explode(_further()).alias("key"))
    deeper = store(sized(deeper, "key"), "simhash-deeper")
    middle = _verified(_paired(deeper.where(F.col("n") <= LONG).select("fp", "key"), ["key"]), 4)

    found, long = short.select("a", "b").unionByName(middle.select("a", "b")), deeper.where(F.col("n") > LONG)
    if long.isEmpty():
        return found
    # what is still long: lists of one 32-bit half by a slice of the other, compared with the centre first
    sliced = long.select("fp", "key", F.explode(_slices()).alias("slice"))
    on = ["key", "slice"]
    # the centre is the member nearest to the most frequent bytes
    modes = [F.mode(_byte("fp", p), True).alias(f"m{p}") for p in range(8)]
    majority = F.lit(0).cast("long")
    for p in reversed(range(8)):
        majority = F.shiftleft(majority, 8).bitwiseOR(F.col(f"m{p}"))
    sliced = store(sliced, "simhash-sliced")
    middles = sliced.groupBy(*on).agg(*modes, F.count("*").alias("m")).where("m > 1").select(*on, majority.alias("majority"))
    ranked = sliced.hint("merge").join(middles, on)
    centre = ranked.groupBy(*on).agg(F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("majority"))).alias("d"), "fp")).alias("c")).select(*on, F.col("c.fp").alias("centre"))
    placed = store(sliced.hint("merge").join(centre, on).withColumn("hangs", F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= MAX_BITS), "simhash-placed")
    hung = placed.where("hangs and fp <> centre").select(F.col("fp").alias("a"), F.col("centre").alias("b"))
    loose, others = placed.where("not hangs").select(*on, F.col("fp").alias("a")), placed.select(*on, F.col("fp").alias("b"))
    apart = loose.hint("merge").join(others, on).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
    return found.unionByName(hung).unionByName(apart.select("a", "b"))


def near_dedup(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp, component_id of every row. Only one row of each fingerprint is a node of the link graph."""
    marked = store(fingerprints(docs, words), "simhash")
    classes = store(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    roots = components(links(classes)).withColumnsRenamed({"node": "fp"})
    rooted = store(classes.hint("merge").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.hint("merge").join(smallest, "root").select("fp", "n", "component_id")
    return join_hot(marked, store(named, "simhash-named"), "fp", "n").select("doc_id", "fp", "component_id")


def contract(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_dedup(docs, words).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
