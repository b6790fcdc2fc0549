"""Language-model scoring with Katz back-off: bigrams over unigrams over one unknown word.

    P(w | h) = d_r r / c(h)            if the pair was seen r times in training
             = alpha(h) P(w)           else
    P(w)     = d_r r / N               if the word was seen r times
             = the mass left over      for any unknown word (one type, as in the base score)

d_r are Good-Turing discounts (Katz's form for r <= K, 1 above), for pairs and for words, and alpha(h) is the discounted
mass of h over the unigram mass of the words not seen after h, so that the probabilities after every h sum to one exactly.
Where counts of counts are too thin for a discount between 0 and 1, 1 - 1/(2r) stands in; a context whose pairs are all
too frequent to be discounted counts one event more, and so do the words where none is discounted. The context of a
first word is the beginning; the end of a text is a word, not a context.

Execution. Texts are read once and written as blocks (a few MB of text each): local word ids of all tokens and the
distinct words as 64-bit XXH64. Distinct words with their training counts go to buckets by hash, which count them, give
them global ids, keep the unigram table and answer every block. With these, distinct pairs of each block go to buckets by
context, which keep the bigram table and answer with the pair's count, or with what alpha needs. Contexts of more than
1/HOT of all tokens (fewer than HOT + 1) are dealt over all buckets and their sums, a bounded table, are broadcast.
Each block then scores its tokens from the answers, recursively from pair to word to unknown. No table is collected, a
key reaches a bucket once for each block, and every intermediate is written to the shared folder.

Defined results: null text counts as empty, which is one token, the end; a null doc_id is neither held out nor learned
from; without training rows every probability is 1 and every score 0; repeated rows count and score each; an empty table
gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import LOWER, crc_mod, partitions, store, sweep, texts

#: Discounts apply to counts up to K. Contexts of more than 1/HOT of the tokens are dealt over all buckets.
K, HOT = 5, 4096
#: Bytes of text in a block, and entries of a bucket, about.
BLOCK, BUCKET = 5 << 20, 1_000_000
END = b" "  # no word holds a blank
#: Columns of a hot context's part in a bucket.
_PART = ["key", *(f"n{k}" for k in range(K)), "mass"]


def planes(x: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane and compressed, behind their kind and number."""
    if x.dtype == np.float64:
        kind = 9
    elif x.dtype == np.uint64 or len(x) and (x.min() < -(2**31) or x.max() >= 2**31):
        kind = 8
    else:
        kind, x = 4, x.astype(np.int32)
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, kind & 12).T).tobytes()
    return struct.pack("<BI", kind, len(x)) + zstandard.ZstdCompressor(level=1).compress(raw)


def flat(raw: bytes, kind: type = np.int64) -> np.ndarray:
    """The numbers again; those that fit come as 32-bit ones."""
    own, n = struct.unpack_from("<BI", raw)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[5:]), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data.reshape(own & 12, -1).T).view({4: np.int32, 8: kind, 9: np.float64}[own]).reshape(-1)


def count_of(raw: bytes) -> int:
    return struct.unpack_from("<BI", raw)[1]


# -- the model ---------------------------------------------------------------------------------------------------------


def discounts(of_counts: list[int]) -> np.ndarray:
    """d_0 .. d_K (d_0 is not used) from n_1 .. n_{K+1}."""
    n = [0, *of_counts]
    out = np.ones(K + 1)
    for r in range(1, K + 1):
        d = -1.0
        if n[1] and n[r]:
            cut = (K + 1) * n[K + 1] / n[1]
            if cut < 1:
                d = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut)
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


@dataclass
class Unigrams:
    """total: N; types: V; d: discounts; left: the mass of the unknown word; scale: what a discounted count is divided by."""

    total: int
    types: int
    d: np.ndarray
    left: float
    scale: float

    @classmethod
    def of(cls, total: int, types: int, of_counts: list[int]) -> Unigrams:
        d = discounts(of_counts)
        lost = sum(of_counts[r - 1] * r * (1 - d[r]) for r in range(1, K + 1))
        if lost <= 0:
            return cls(total, types, d, 1 / (total + 1), total + 1.0)
        return cls(total, types, d, lost / total, float(total))

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, np.where(c > K, 1.0, self.d[np.minimum(c, K)]) * c / self.scale, self.left)


def pair_p(r: np.ndarray, total: np.ndarray, d: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """P of seen pairs; whole: nothing of the context is discounted."""
    return np.where(r > K, 1.0, d[np.minimum(r, K)]) * r / (total + whole)


def alphas(total: np.ndarray, low: np.ndarray, mass: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Back-off weights. low: pairs seen 1..K times (n x K); mass: unigram mass of the words seen after the context."""
    lost = low @ (np.arange(1, K + 1) * (1 - d[1:]))
    whole = low.sum(1) == 0
    left = np.where(whole, 1 / (total + 1), lost / np.maximum(total, 1))
    return np.where(total > 0, left / np.maximum(1 - mass, 1e-12), 1.0)


# -- blocks ------------------------------------------------------------------------------------------------------------

BLOCKS = "block_id long, doc_ids array<long>, held array<boolean>, lengths binary, tokens binary, words binary, places binary, n_tokens long, n_words long"

_BLOCKS = pa.schema([
    ("block_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((c, pa.binary()) for c in ("lengths", "tokens", "words", "places")), ("n_tokens", pa.int64()), ("n_words", pa.int64()),
])


def blocks(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """The table as blocks. held: the row is not learned from (a null id is neither)."""
    marked = texts(docs).withColumn("held", crc_mod("doc_id", modulus) == remainder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, held, tokens, lengths, vocabulary, size = [], [], [], [], {END: 0}, 0

        def block() -> pa.RecordBatch:
            flat_tokens = np.concatenate(tokens)
            often = np.argsort(-np.bincount(flat_tokens, minlength=len(vocabulary)), kind="stable")
            place = np.empty(len(often), np.int32)
            place[often] = np.arange(len(often))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))[often]
            by_hash = np.argsort(hashes)
            places = np.empty(len(often), np.int32)
            places[by_hash] = np.arange(len(often))
            columns = [[part << 24 | made], [ids], [held], [planes(np.array(lengths, np.int64))], [planes(place[flat_tokens])], [planes(hashes[by_hash])], [planes(places)], [len(flat_tokens)], [len(often)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCKS)], schema=_BLOCKS)

        for batch in batches:
            for doc_id, text, out in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
                for w in set(words).difference(vocabulary):
                    vocabulary[w] = len(vocabulary)
                words.append(END)
                tokens.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                held.append(out)
                lengths.append(len(words))
                size += len(text)
                if size >= BLOCK:
                    yield block()
                    made += 1
                    ids, held, tokens, lengths, vocabulary, size = [], [], [], [], {END: 0}, 0
        if ids:
            yield block()

    return marked.mapInArrow(run, BLOCKS)


class Block:
    """A block's tokens. lead: the token before each, -1 at the beginning of a text; learn: tokens of training rows."""

    def __init__(self, row: dict):
        self.id, self.doc_ids, self.held = row["block_id"], row["doc_ids"], row["held"]
        self.lengths, self.tokens = flat(row["lengths"]).astype(np.int64), flat(row["tokens"])
        self.n_words = row["n_words"]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.learn = np.repeat(np.array([h is False for h in self.held]), self.lengths)
        self.lead = np.roll(self.tokens, 1)
        self.lead[self.starts] = -1
        self.places = flat(row["places"])

    def known(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Global id and training count of each local word, from the answers of all buckets, which part the hashes' range."""
        parts = sorted((a for a in answers if a["kind"] == "word"), key=lambda a: a["bucket"])
        return tuple(np.concatenate([flat(a[c]) for a in parts])[self.places] for c in ("x", "y"))

    def pairs(self, ids: np.ndarray, counts: np.ndarray, buckets: int, hot_from: float) -> tuple[np.ndarray, ...]:
        """Distinct pairs: local context and word, global ones, hot, bucket, order by bucket; and each token's pair."""
        keys, of = np.unique((self.lead.astype(np.int64) + 1) * (self.n_words + 1) + self.tokens, return_inverse=True)
        h, w = keys // (self.n_words + 1) - 1, keys % (self.n_words + 1)
        gh, gw = np.where(h < 0, 0, ids[h]), ids[w]
        hot = (h < 0) | (counts[h] >= hot_from)
        mixed = (gh.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.where(hot, gw, 0).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
        kind = (mixed % np.uint64(buckets)).astype(np.int64)
        return h, w, gh, gw, hot, kind, np.lexsort((gw, gh, kind)), of


ASKED = "bucket long, block_id long, x binary, y binary, z binary, u binary"
GIVEN = "bucket long, block_id long, kind string, x binary, y binary, z binary, stats array<long>"
_ASKED = pa.schema([("bucket", pa.int64()), ("block_id", pa.int64()), *((c, pa.binary()) for c in "xyzu")])
_GIVEN = pa.schema([("bucket", pa.int64()), ("block_id", pa.int64()), ("kind", pa.string()), *((c, pa.binary()) for c in "xyz"), ("stats", pa.list_(pa.int64()))])


def _cuts(kind: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each run in sorted bucket numbers."""
    edges = np.flatnonzero(np.diff(kind, prepend=-1))
    return [(int(kind[a]), int(a), int(b)) for a, b in zip(edges, [*edges[1:], len(kind)])]


def ask_words(table: DataFrame, buckets: int) -> DataFrame:
    """Hashes and training counts of each block's words, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                counts = np.bincount(block.tokens[block.learn], minlength=block.n_words).astype(np.int64)
                hashes, ranked = flat(row["words"], np.uint64), np.empty(block.n_words, np.int64)
                ranked[block.places] = counts
                kind = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                rows = [(b, block.id, planes(hashes[i:j]), planes(ranked[i:j]), None, None) for b, i, j in _cuts(kind)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASKED)], schema=_ASKED)

    return table.mapInArrow(run, ASKED)


def _histogram(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2].tolist()


def answer_words(asked: DataFrame, buckets: int) -> DataFrame:
    """The unigram table, bucket by bucket (kind 'table'), and the answers to the blocks (kind 'word').

    stats of a table row: tokens, types, and the number of types with each count 1 .. K + 1.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        bucket = rows[0]["bucket"]
        each = [flat(r["x"], np.uint64) for r in rows]
        hashes, of = np.unique(np.concatenate(each), return_inverse=True)
        total = np.zeros(len(hashes), np.int64)
        np.add.at(total, of, np.concatenate([flat(r["y"]) for r in rows]))
        ids = np.arange(len(hashes)) * buckets + bucket + 1  # 0: the beginning
        seen = total[total > 0]
        out = [(bucket, None, "table", planes(hashes), planes(total), None, [int(total.sum()), len(seen), *_histogram(seen)])]
        at = 0
        for row, x in zip(rows, each):
            mine = of[at : at + len(x)]
            at += len(x)
            out.append((bucket, row["block_id"], "word", planes(ids[mine]), planes(total[mine]), None, None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _GIVEN)], schema=_GIVEN)

    return asked.groupBy("bucket").applyInArrow(run, GIVEN)


def with_answers(table: DataFrame, *given: DataFrame) -> DataFrame:
    """Each block with the answers to it (as many as there are buckets, in sum as large as the block)."""
    answers = None
    for g in given:
        own = g.where("block_id IS NOT NULL").select("block_id", F.struct("kind", "bucket", "x", "y", "z").alias("a"))
        answers = own if answers is None else answers.unionByName(own)
    return table.drop("words").join(answers.groupBy("block_id").agg(F.collect_list("a").alias("answers")), "block_id")


def ask_pairs(answered: DataFrame, buckets: int, hot_from: float) -> DataFrame:
    """Distinct pairs of each block by bucket: context, word, training count, training count of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = Block(row)
                ids, counts = block.known(row["answers"])
                _, w, gh, gw, hot, kind, order, of = block.pairs(ids, counts, buckets, hot_from)
                times = np.bincount(of[block.learn], minlength=len(gh)).astype(np.int64)
                columns = [x[order] for x in (np.where(hot, -gh - 1, gh), gw, times, counts[w])]
                steps = lambda c: np.diff(c, prepend=c.dtype.type(0))  # noqa: E731  # contexts come in runs
                rows = [(b, block.id, planes(steps(columns[0][i:j])), *(planes(c[i:j]) for c in columns[1:])) for b, i, j in _cuts(kind[order])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASKED)], schema=_ASKED)

    return answered.mapInArrow(run, ASKED)


def answer_pairs(asked: DataFrame, unigrams: Unigrams) -> DataFrame:
    """The bigram table, bucket by bucket (kind 'table'), parts of hot contexts (kind 'hot'), and answers (kind 'pair').

    An answer has the count r of each pair (-r where its context has no pair to discount), and for each distinct cold
    context with an unseen pair the numbers n_1 .. n_K (in y, context by context) and the unigram mass (in z).
    """

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        bucket = rows[0]["bucket"]
        h = np.concatenate([np.cumsum(flat(r["x"]), dtype=np.int64) for r in rows])  # below 0: hot
        w = np.concatenate([flat(r["y"]) for r in rows]).astype(np.int64)
        times = np.concatenate([flat(r["z"]) for r in rows])
        of_word = np.concatenate([flat(r["u"]) for r in rows])
        sizes = [count_of(r["x"]) for r in rows]
        order = np.lexsort((w, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
        of = np.empty(len(h), np.int64)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        total = np.bincount(of, times, len(first)).astype(np.int64)
        uh, uw, uc = h[first], w[first], of_word[first]
        heads = np.flatnonzero(np.diff(uh, prepend=np.iinfo(np.int64).min))  # first pair of each context
        context = np.repeat(np.arange(len(heads)), np.diff([*heads, len(uh)]))
        low = np.zeros((len(heads), K), np.int64)
        some = (total > 0) & (total <= K)
        np.add.at(low, (context[some], total[some] - 1), 1)
        mass = np.bincount(context, np.where(total > 0, unigrams.p(uc), 0), len(heads))
        seen = total > 0
        out = [(bucket, None, "table", planes(uh[seen]), planes(uw[seen]), planes(total[seen]), [int(total.sum()), int(seen.sum()), *_histogram(total[seen])])]
        hot = uh[heads] < 0
        if hot.any():
            out.append((bucket, None, "hot", planes(-uh[heads][hot] - 1), planes(low[hot].reshape(-1)), planes(mass[hot]), None))
        sign = np.where((low.sum(1) == 0) & ~hot, -1, 1)[context]
        at = 0
        for row, n in zip(rows, sizes):
            mine = of[at : at + n]
            at += n
            c = context[mine]
            asks = (total[mine] == 0) & ~hot[c]
            needed = c[asks][np.diff(c[asks], prepend=-1) != 0]  # pairs of a block come in the order of contexts
            out.append((bucket, row["block_id"], "pair", planes((total * sign)[mine]), planes(low[needed].T.reshape(-1)), planes(mass[needed]), None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _GIVEN)], schema=_GIVEN)

    return asked.groupBy("bucket").applyInArrow(run, GIVEN)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_blocks(answered: DataFrame, buckets: int, hot_from: float, unigrams: Unigrams, d: np.ndarray, ends: int, hot: dict) -> DataFrame:
    """Scores of every row. hot: context -> (n_1 .. n_K, mass); ends: training rows; d: discounts of pairs."""
    keys = np.array(sorted(hot), np.int64)
    tables = (keys, np.array([hot[k][0] for k in keys.tolist()], np.int64).reshape(-1, K), np.array([hot[k][1] for k in keys.tolist()]))
    fixed = answered.sparkSession.sparkContext.broadcast((unigrams, d, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, d2, (hot_keys, hot_low, hot_mass) = fixed.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = Block(row)
                ids, counts = block.known(row["answers"])
                h, w, gh, _, is_hot, kind, order, of = block.pairs(ids, counts, buckets, hot_from)
                parts = sorted((a for a in row["answers"] if a["kind"] == "pair"), key=lambda a: a["bucket"])
                r = np.empty(len(h), np.int64)
                r[order] = np.concatenate([flat(a["x"]) for a in parts])
                whole = r < 0
                r = np.abs(r)
                total = np.where(h < 0, ends, counts[h])
                alpha = np.ones(len(h))  # of a context that was never seen
                asks = order[(r[order] == 0) & ~is_hot[order]]
                if len(asks):
                    new = (np.diff(gh[asks], prepend=-1) != 0) | (np.diff(kind[asks], prepend=-1) != 0)
                    given_low = np.concatenate([flat(a["y"]).reshape(K, -1).T for a in parts])
                    given_mass = np.concatenate([flat(a["z"]) for a in parts])
                    alpha[asks] = alphas(total[asks][new], given_low, given_mass, d2)[np.cumsum(new) - 1]
                if is_hot.any() and len(hot_keys):
                    mine = np.flatnonzero(is_hot)
                    spot = np.minimum(np.searchsorted(hot_keys, gh[mine]), len(hot_keys) - 1)
                    mine, spot = mine[hot_keys[spot] == gh[mine]], spot[hot_keys[spot] == gh[mine]]
                    used, first, back = np.unique(spot, return_index=True, return_inverse=True)
                    alpha[mine] = alphas(total[mine][first], hot_low[used], hot_mass[used], d2)[back]
                    whole[mine] = (hot_low[used].sum(1) == 0)[back]
                p = np.where(r > 0, pair_p(r, np.maximum(total, 1), d2, whole), alpha * uni.p(counts[w]))
                known = counts[block.tokens] > 0
                base = np.log10((counts[block.tokens] + 1) / (uni.total + uni.types + 1))
                columns = [
                    pa.array(block.doc_ids, pa.int64()), pa.array([bool(x) for x in block.held]), pa.array(block.lengths),
                    pa.array(np.add.reduceat(known.astype(np.int64), block.starts)), pa.array(np.full(len(block.lengths), uni.total)),
                    pa.array(np.add.reduceat(base, block.starts)), pa.array(np.add.reduceat(np.log10(p)[of], block.starts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCORES.split(", ")])

    return answered.mapInArrow(run, SCORES)


def hot_sums(pairs: DataFrame) -> DataFrame:
    """key, low (n_1 .. n_K), mass of every hot context, summed over the buckets; each bucket's part is one row a context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, low = flat(row["x"]).astype(np.int64), flat(row["y"]).astype(np.int64).reshape(-1, K)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(low[:, k]) for k in range(K)), pa.array(flat(row["z"]).astype(float))], names=_PART)

    each = pairs.where("kind = 'hot'").select("x", "y", "z").mapInArrow(run, ", ".join(f"{n} {'double' if n == 'mass' else 'long'}" for n in _PART))
    sums = each.groupBy("key").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(K)), F.sum("mass").alias("mass"))
    return sums.select("key", F.array(*(f"n{k}" for k in range(K))).alias("low"), "mass")


def _stats(given: DataFrame) -> list[int]:
    """Sums of the table rows' statistics."""
    sums = given.where("kind = 'table'").agg(*(F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(K + 3))).first()
    return [int(x or 0) for x in sums]


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    table = store(blocks(docs, modulus, remainder), "katz-blocks")
    sums = table.agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("t")).first()
    if not sums["w"]:
        return spark.createDataFrame([], SCORES)
    word_buckets = max(partitions(spark), int(sums["w"]) // BUCKET)
    words = store(answer_words(ask_words(table, word_buckets), word_buckets), "katz-words")
    total, types, *of_counts = _stats(words)
    unigrams = Unigrams.of(total, types, of_counts)
    hot_from = max(64.0, total / HOT)
    sweep(spark)
    buckets = max(partitions(spark), int(sums["t"]) // BUCKET)
    asked = ask_pairs(with_answers(table, words), buckets, hot_from)
    pairs = store(answer_pairs(asked, unigrams), "katz-pairs")
    _, _, *of_pairs = _stats(pairs)
    del asked
    sweep(spark)
    hot = {r["key"]: (tuple(r["low"]), r["mass"]) for r in hot_sums(pairs).collect()}  # HOT + 1 rows at most
    ends = int(table.select(F.explode("held").alias("h")).where("NOT h").count())
    return score_blocks(with_answers(table, words, pairs), buckets, hot_from, unigrams, discounts(of_pairs), ends, hot)
