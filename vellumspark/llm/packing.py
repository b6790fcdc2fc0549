"""Packing documents into training sequences: cutting stock by column generation.

Tokens are counted (and optionally kept) by a public tokenizer; a document longer than a sequence is cut into full
sequences and a rest. Lengths are rounded up to UNIT tokens, which gives at most CAPACITY / UNIT length classes whatever
the input. On their histogram the driver solves the linear relaxation of the cutting-stock problem: a revised simplex
over packing patterns, where a knapsack dynamic program prices new patterns. Whole parts of the solution become patterns
with multiplicities, what is left is packed greedily by the same classes. The patterns (a bounded table) are then laid
over the documents, which are ranked inside their class: rank -> pattern, copy, slot. Ranks come from counts by class and
salt, so a class that holds a third of all rows is ranked in many tasks.

Defined results: null text counts as empty; an empty text is a piece of one token (the end); repeated rows are packed
once for each row; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import LOWER, give_back, store, texts

CAPACITY = 4096
UNIT = 8
END_ID = 2
#: Chunks of each of the two generations that a Python worker keeps; bounds its memory.
CACHE = 400_000
#: Bytes of text that a worker cuts into chunks at a time.
SLICE = 1 << 22
#: The knapsack stops pricing at this gain, or after so many columns: the plan stays valid, only less tight.
GAIN, COLUMNS = 1e-4, 6000
#: Pieces of a class that are ranked in one task, about.
PART = 250_000
#: Weight of the steady duals in pricing.
SMOOTH = 0.9
#: Stands between chunks that are encoded together. One code point that is one token and merges with nothing around it.
_MARK = "★"


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 is itself, the rest follows from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


class ChunkEncoder:
    """Token ids of whole texts, with the ids of chunks between blanks kept in a bounded cache.

    The tokenizer drops white space before its merges, so a text's ids are those of its chunks, one after another. It
    lower-cases, so chunks are told apart after lower-casing A-Z. Chunks of small Latin letters with a tail of
    punctuation are two words to its pattern; for these a copy of the model without normaliser and pattern is enough.
    """

    _LATIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]*)")

    def __init__(self, path: str, room: int):
        from tokenizers import Tokenizer

        self.room = room

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        bare = parts | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        alone = self._ids(self.tokenizer, [_MARK])[0]
        latin = "x" + "".join(map(chr, range(0xDF, 0x100))).replace("÷", "")
        same = self._ids(self.tokenizer, [latin])[0] == self._ids(self.bare, [self._mapped(latin)])[0]
        self.mark = alone[0] if len(alone) == 1 and same and self._ids(self.bare, [self._mapped(_MARK)])[0] == alone else None
        #: Letters, so bytes, of each token without the mark of a word's end: where a chunk's ids end follows from the sums.
        spelt, end = self.bare.get_vocab(with_added_tokens=False), parts["model"].get("end_of_word_suffix") or ""
        self.sizes = np.zeros(max(spelt.values(), default=-1) + 1, np.int64)
        self.sizes[list(spelt.values())] = [len(x.removesuffix(end)) for x in spelt]

    def _mapped(self, chunk: str) -> str:
        return chunk.encode().decode("latin-1").translate(self.letters)

    @staticmethod
    def _ids(tokenizer, parts: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Fill the cache. Latin chunks are a stem and a tail; each stem and each tail is encoded once."""
        latin, plain, odd, stems = [], [], [], set()
        for c in chunks:
            if c.isascii() and c.isalpha():
                stems.add(c)
            elif self.mark is None or _MARK in c:
                odd.append(c)
            elif m := self._LATIN.fullmatch(c):
                latin.append((c, m[1], m[2]))
                if m[1] not in self.cache:
                    stems.add(m[1])
            else:
                plain.append(c)
        if self.mark is None:
            odd += stems
            stems = set()
        stems = list(stems)
        for at in range(0, len(stems), 20_000):
            some = stems[at : at + 20_000]
            mapped = [c if c.isascii() else self._mapped(c) for c in some]
            ids = np.array(self._ids(self.bare, [" ".join(mapped)])[0], np.int64)
            sizes, wanted = self.sizes[ids], np.cumsum(np.fromiter(map(len, mapped), np.int64, len(mapped)))
            reached = np.cumsum(sizes)
            ends = np.searchsorted(reached, wanted)
            if not sizes.all() or reached[-1] != wanted[-1] or (reached[ends] != wanted).any():
                odd += some
                continue
            self._keep(some, ids, 4 * (ends + 1), 0)
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            ids = np.array(self._ids(self.tokenizer, [f" {_MARK} ".join(some)])[0], np.int64)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(some) - 1:
                odd += some
                continue
            self._keep(some, ids, 4 * np.append(cuts, len(ids)), 4)
        for c, ids in zip(odd, self._ids(self.tokenizer, odd) if odd else []):
            self.cache[c] = np.array(ids, "<u4").tobytes()
        for c, stem, tail in latin:
            if (ids := self.tails.get(tail)) is None:
                ids = self.tails[tail] = np.array(self._ids(self.tokenizer, [tail])[0], "<u4").tobytes()
            self.cache[c] = self.cache[stem] + ids

    def _keep(self, chunks: list[str], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        """Put the ids of chunks that were encoded together into the cache; ``gap`` bytes stand between two of them."""
        raw, ends = ids.astype("<u4").tobytes(), ends.tolist()
        self.cache.update(zip(chunks, map(raw.__getitem__, map(slice, [0, *(e + gap for e in ends[:-1])], ends))))

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [x.encode().translate(LOWER).decode().replace("\n", " ").split(" ") for x in batch]
        new = set().union(*split).difference(self.cache)
        if len(self.cache) + len(new) > self.room:  # what is used again moves from the older generation to the new one
            self.before, self.cache, self.tails = self.cache, {}, {"": b""}
            new = set().union(*split)
        before = self.before
        again = [c for c in new if c in before]
        self.cache.update((c, before[c]) for c in again)
        self._learn(list(new.difference(again)))
        get = self.cache.__getitem__
        return [b"".join(map(get, parts)) for parts in split]


@lru_cache(maxsize=2)
def encoder(path: str, room: int = CACHE) -> ChunkEncoder:
    return ChunkEncoder(path, room)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each."""
    at, size = 0, 0
    for k, x in enumerate(batch.column(1)):
        size += len(x.as_buffer()) if x.is_valid else 0
        if size >= most:
            yield batch.slice(at, k + 1 - at)
            at, size = k + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, room: int = CACHE, hold: bool = True, most: int = SLICE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and on demand ids (array<int>).

    room, hold: chunks in a generation of a worker's cache, and whether it outlives a task. Less of both takes more CPU
    and less memory; results are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or tokenizer_path(), room).encode
        for batch in (part for whole in batches for part in _slices(whole, most)):
            rows: list[tuple] = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                raw += struct.pack("<I", END_ID)
                n = len(raw) // 4
                for start in range(0, n, capacity):
                    part = raw[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n, part))
            columns = [pa.array(x, pa.int64()) for x in list(zip(*rows))[:5]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(r[5], "<i4") for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if not hold:
            encoder.cache_clear()
            del encode
            give_back()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return texts(docs).mapInArrow(run, schema)


def knapsack(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best multiset of sizes (ascending) within ``room``, unbounded; its value and the count of each size."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = best[c - sizes[:k]] + value[:k]
            j = int(gain.argmax())
            if gain[j] > best[c] + 1e-12:
                best[c], last[c] = gain[j], j
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[room]), counts


def _pivot(inverse: np.ndarray, step: np.ndarray, out: int) -> None:
    """The basis inverse after the column with coordinates ``step`` has taken the place ``out``."""
    row = inverse[out] / step[out]
    inverse -= np.outer(step, row)
    inverse[out] = row


def relaxed(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and their fractional use that cover ``demand`` with the fewest sequences."""
    m = len(sizes)
    # The first basis packs the largest pieces first, and fills up with smaller ones, as far as a class lasts. Each such
    # pattern uses up a class that no later one has, so the columns are triangular.
    basis, x, left = [np.eye(m, dtype=np.int64)[k] * (room // sizes[k]) for k in range(m)], np.zeros(m), demand.astype(float).copy()
    cost, inverse = np.ones(m), np.diag(1.0 / (room // sizes))
    while left.any():
        free, column = room, np.zeros(m, np.int64)
        for k in np.flatnonzero(left)[::-1]:
            column[k] = min(math.ceil(left[k]), free // sizes[k])
            free -= column[k] * sizes[k]
        used = np.flatnonzero(column)
        over = used[(left[used] / column[used]).argmin()]
        basis[over], x[over] = column, left[over] / column[over]
        _pivot(inverse, inverse @ column, over)
        left = left - column * x[over]
        left[(left < 1e-9) | (np.arange(m) == over)] = 0
    # Pricing at duals between the current ones and the best so far (at first: each size's share of a sequence) steers
    # the columns to full patterns; a column that doesn't pay at the current duals is priced again at these.
    steady, bound = sizes / room, float(demand @ sizes) / room
    for _ in range(COLUMNS):
        dual = cost @ inverse
        if dual.min() < -1e-9:  # more than the demand of a class: a surplus
            column, price = -np.eye(m, dtype=np.int64)[int(dual.argmin())], 0.0
        else:
            if float(dual @ demand) <= bound * (1 + GAIN):
                break
            price, near = 1.0, SMOOTH * steady + (1 - SMOOTH) * dual
            value, column = knapsack(near, sizes, room)
            if (reached := float(near @ demand) / max(1.0, value)) > bound:
                steady, bound = near / max(1.0, value), reached
            if dual @ column <= 1 + GAIN:
                value, column = knapsack(dual, sizes, room)
                if value <= 1 + GAIN:
                    break
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * step
        x[out] = ratio[out]
        _pivot(inverse, step, out)
        basis[out], cost[out] = column, price
    return [(basis[k], float(x[k])) for k in range(m) if cost[k] and x[k] > 1e-9]


def plan(counts: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (slots of each class 0..room) with multiplicities that hold ``counts`` pieces of each class."""
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return []
    left, found = counts[sizes].astype(np.int64).copy(), []

    def take(pattern: np.ndarray, times: int) -> None:
        full = np.zeros(room + 1, np.int64)
        full[sizes] = pattern
        found.append((full, times))
        np.subtract(left, pattern * times, out=left)

    for pattern, use in sorted(relaxed(sizes, left.astype(float), room), key=lambda p: -p[1]):
        used = pattern > 0
        times = min(int(use + 1e-6), int((left[used] // pattern[used]).min()))
        if times:
            take(pattern, times)
    while left.any():  # at most a few patterns a class are left over
        free, pattern = room, np.zeros(len(sizes), np.int64)
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(left[k], free // sizes[k])
            free -= pattern[k] * sizes[k]
        used = pattern > 0
        take(pattern, int((left[used] // pattern[used]).min()))
    return found


def pack(cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """``cut`` (a stored frame of pieces, each with a ``uid`` of its own) with sequence_id and offset.

    A class is ranked in as many parts as its count asks for (PART pieces a part, about), dealt by the piece's uid, so no
    part grows with the table. The driver holds one number for each part.
    """
    spark = cut.sparkSession
    room = capacity // unit
    classed = cut.withColumn("_class", F.ceil(F.col("length") / unit).cast("int"))
    sizes = np.zeros(room + 1, np.int64)
    for c, n in classed.groupBy("_class").count().collect():  # a row for each class
        sizes[c] = n
    parts = np.maximum(1, -(-sizes // PART))
    salts = F.element_at(F.array(*(F.lit(int(n)) for n in parts)), F.col("_class") + 1)
    salted = classed.withColumn("_salt", F.pmod(F.xxhash64("uid"), salts).cast("int"))
    at = np.cumsum(parts) - parts
    counts = np.zeros(int(parts.sum()), np.int64)
    counts[at] = sizes
    counts[at[parts > 1]] = 0
    for c, s, n in salted.where(salts > 1).groupBy("_class", "_salt").count().collect():  # a row for each PART pieces
        counts[at[c] + s] = n
    before = np.cumsum(counts) - counts
    before -= np.repeat(before[at], parts)
    patterns = plan(sizes, room)
    times = np.array([t for _, t in patterns], np.int64)
    first = np.cumsum(times) - times
    tables = {}
    for c in range(room + 1):
        has = [p for p, (a, _) in enumerate(patterns) if a[c]]
        slots = np.array([patterns[p][0][c] for p in has], np.int64)
        lead = np.array([patterns[p][0][c + 1 :].sum() for p in has], np.int64)  # larger pieces come first
        ends = np.cumsum(slots * times[has]) if has else np.zeros(0, np.int64)
        tables[c] = (ends, slots, first[has] if has else ends, lead)
    shared = spark.sparkContext.broadcast((at, before, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_of, offsets, by_class = shared.value
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            get = lambda n: batch.column(at[n]).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
            kind, salt, rank = get("_class"), get("_salt"), get("_rank")
            rank = rank - 1 + offsets[start_of[kind] + salt]
            sequence, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for c in np.unique(kind).tolist():
                mine = np.flatnonzero(kind == c)
                ends, slots, start, lead = by_class[c]
                p = np.searchsorted(ends, rank[mine], side="right")
                local = rank[mine] - np.concatenate([[0], ends])[p]
                sequence[mine] = start[p] + local // slots[p]
                slot[mine] = lead[p] + local % slots[p]
            keep = [k for n, k in at.items() if n not in ("_class", "_salt", "_rank")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(sequence), pa.array(slot)], names=[*(batch.schema.names[k] for k in keep), "sequence_id", "_slot"]
            )

    order = [c for c in ("doc_id", "start", "length", "ids_crc32", "uid") if c in cut.columns]
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("_class", "_salt").orderBy(*order)))
    from pyspark.sql.types import LongType, StructType

    schema = StructType([*cut.schema.fields]).add("sequence_id", LongType()).add("_slot", LongType())
    placed = ranked.mapInArrow(run, schema)
    inside = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("_slot", "uid")


def contract(docs: DataFrame, path: str | None = None, room: int = CACHE, hold: bool = True, most: int = SLICE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return pack(store(pieces(docs, path, room=room, hold=hold, most=most).withColumn("uid", F.monotonically_increasing_id()), "pieces"))
