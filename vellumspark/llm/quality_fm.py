"""Quality classifier: a second-order factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), so the pairwise interactions
cost time linear in the features. Features are lower-cased words hashed into BUCKETS (weight: square root of the count over
the square root of all words), statistics of the text's structure in bins (one-hot), and the table's metadata where it has
any: the stated length ``n_chars``, in bins, and whether it is missing, true or false. Labels, lang, source and doc_id are
never inputs.

The model is fitted on the driver on at most ``rows`` labelled documents (TRAIN_ROWS, a documented bound: those with the
smallest xxhash64 of their id), so its cost doesn't grow with the table; every document is scored, whole.

Defined results: null text counts as empty, and an empty text gets a score like any other; labels whose quality is null
don't count; several labels of one document are averaged; with no usable label, or labels of one class only, every
score is near that class (0.5 with none); a null doc_id can't be labelled, and is not held out; a table without n_chars
is one whose lengths are all missing; of rows that repeat a labelled id one is learned from, and all are scored; texts of
any length are read whole; an empty table gives an empty one; other columns are ignored by the score and kept by ``keep``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import LOWER, crc_mod, give_back

BUCKETS = 1 << 13
FACTORS = 6
TRAIN_ROWS = 6000
EPOCHS = 12
BATCH = 64
RATE = 0.08
L2_LINEAR, L2_FACTORS = 2e-5, 2e-4
#: Bins of each statistic: upper borders; one more bin lies above the last.
SHARE_BINS = (0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
COUNT_BINS = (0, 1, 3, 8, 20, 50, 120, 300, 800, 2000, 6000)
LENGTH_BINS = (0, 20, 80, 200, 500, 1200, 3000, 8000, 20_000, 60_000)
_OTHER = re.compile(rb"[^A-Za-z0-9\x80-\xff\s.,;:'\"()?-]")


def statistics(raw: bytes, words: list[bytes], counts: Counter, stated: int | None, length: int) -> list[tuple[float, tuple[float, ...]]]:
    """(value, bins) of each statistic of the structure and of the metadata."""
    n, size = max(1, len(words)), max(1, len(raw))
    lines = raw.split(b"\n")
    upper = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    lower = len(raw) - len(raw.translate(None, bytes(range(97, 123))))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    odd = len(_OTHER.findall(raw))
    twice = sum(a == b for a, b in zip(words, words[1:]))
    top = max(counts.values(), default=0)
    return [
        (len(words), COUNT_BINS),
        (len(lines), COUNT_BINS),
        (upper / max(1, upper + lower), SHARE_BINS),
        (digits / size, SHARE_BINS),
        (odd / size, SHARE_BINS),
        (odd / n, SHARE_BINS),
        (raw.count(b"!") / n, SHARE_BINS),
        (raw.count(b"|") / n, SHARE_BINS),
        (raw.count(b".") / n, SHARE_BINS),
        (twice / n, SHARE_BINS),
        (top / n, SHARE_BINS),
        (len(counts) / n, SHARE_BINS),
        (1 - len(set(lines)) / len(lines), SHARE_BINS),
        (len(raw) / n / 20, SHARE_BINS),
        (stated or 0, LENGTH_BINS),
        (0 if stated is None else 1 + (stated != length), (0, 1)),
    ]


_STAT_BINS = [len(bins) + 1 for _, bins in statistics(b"", [], Counter(), None, 0)]
_STAT_AT = np.cumsum([BUCKETS, *_STAT_BINS]).tolist()
SIZE = _STAT_AT[-1]


def features(text: str, stated: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (int32) and values (float32) of the features of a text with its stated length."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(LOWER).split()
    counts = Counter(words)
    hashed: dict[int, int] = {}
    for word, c in counts.items():
        k = zlib.crc32(word) % BUCKETS
        hashed[k] = hashed.get(k, 0) + c
    index = list(hashed)
    value = np.sqrt(np.fromiter(hashed.values(), np.float32, len(hashed)) / max(1, len(words)))
    for k, (x, bins) in enumerate(statistics(raw, words, counts, stated, len(text))):
        index.append(_STAT_AT[k] + int(np.searchsorted(bins, x, side="left")))
    return np.array(index, np.int32), np.concatenate([value, np.ones(len(_STAT_BINS), np.float32)]).astype(np.float32)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probability of label 1 for each row of features; none may be empty."""
        out = np.empty(len(rows))
        for k, (i, x) in enumerate(rows):
            v = self.factors[i] * x[:, None]
            out[k] = self.bias + self.linear[i] @ x + 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """AdaGrad on the log loss, both classes weighted alike to the power 1/2; deterministic for the rows' order."""
    rng = np.random.default_rng(seed)
    linear, factors = np.zeros(SIZE, np.float32), (rng.standard_normal((SIZE, FACTORS)) * 0.02).astype(np.float32)
    positive = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < positive < 1:
        return Model(8.0 * (2 * positive - 1), linear, np.zeros_like(factors))
    weight = np.where(labels > 0.5, positive**-0.5, (1 - positive) ** -0.5)
    weight /= weight.mean()
    bias, g_bias = float(np.log(positive / (1 - positive))), 1e-3
    g_linear, g_factors = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, FACTORS), 1e-3, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            i = np.concatenate([rows[k][0] for k in chosen])
            x = np.concatenate([rows[k][1] for k in chosen])
            starts = np.cumsum([0, *(len(rows[k][0]) for k in chosen)])[:-1]
            of = np.repeat(np.arange(len(chosen)), np.diff([*starts, len(i)]))
            v = factors[i] * x[:, None]
            total = np.add.reduceat(v, starts, axis=0)
            z = bias + np.add.reduceat(linear[i] * x, starts) + 0.5 * (total**2 - np.add.reduceat(v * v, starts, axis=0)).sum(1)
            error = (weight[chosen] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) / len(chosen)).astype(np.float32)
            keys, back = np.unique(i, return_inverse=True)
            d_linear = np.bincount(back, error[of] * x, len(keys)).astype(np.float32) + L2_LINEAR * linear[keys]
            per = (error[of] * x)[:, None] * (total[of] - v)
            d_factors = np.stack([np.bincount(back, per[:, f], len(keys)) for f in range(FACTORS)], 1).astype(np.float32) + L2_FACTORS * factors[keys]
            g_linear[keys] += d_linear**2
            g_factors[keys] += d_factors**2
            linear[keys] -= RATE * d_linear / np.sqrt(g_linear[keys])
            factors[keys] -= 0.5 * RATE * d_factors / np.sqrt(g_factors[keys])
            g_bias += float(error.sum()) ** 2
            bias -= RATE * float(error.sum()) / g_bias**0.5
    return Model(bias, linear, factors)


def with_length(docs: DataFrame) -> DataFrame:
    """(doc_id, text, stated): the stated length is null where the table has none."""
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), stated.alias("stated"))


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn: Column, rows: int) -> DataFrame:
    """(doc_id, text, stated, y) of at most ``rows`` labelled documents for which ``learn`` holds, one row for each: of
    rows that repeat an id the one with the smallest text is learned from."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.avg("y").alias("y"))
    )
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = with_length(docs).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min(F.struct("text", "stated")).alias("t")).select("doc_id", "t.text", "t.stated", "y")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from rows whose crc32 of the id is not 1 modulo 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py(), n.as_py()) for x, n in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())],
                names=["doc_id", "y", "i", "x"],
            )

    sample = labelled(docs, labels, "quality", crc_mod("doc_id", 3) != 1, rows)
    got = sample.mapInArrow(run, "doc_id long, y double, i binary, x binary").toArrow().sort_by([("doc_id", "ascending"), ("i", "ascending")])
    parts = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for i, x in zip(got["i"].to_pylist(), got["x"].to_pylist())]
    model = fit(parts, (np.array(got["y"].to_pylist(), float) >= 0.5).astype(float))
    del got, parts
    give_back()
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row; the model (a fixed size) is broadcast. A row's features go as soon as it is scored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [float(shared.value.score([features(x.as_py(), n.as_py())])[0]) for x, n in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return with_length(docs).mapInArrow(run, "doc_id long, score double")


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return scores(docs, train(docs, labels)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, all columns; scored in place, so nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return filter_rows(docs, lambda text, stated: float(shared.value.score([features(text, stated)])[0]) >= 0.5, "n_chars")


def filter_rows(docs: DataFrame, accept, beside: str | None = None) -> DataFrame:
    """Rows of ``docs`` whose text (null: empty) is accepted, together with the value of the column ``beside`` (null
    where there is none) if one is named; columns and order inside a batch stay."""
    at = docs.columns.index("text")
    other = docs.columns.index(beside) if beside in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if beside is None:
                kept = [accept(x.as_py() or "") for x in batch.column(at)]
            else:
                values = batch.column(other) if other is not None else pa.nulls(batch.num_rows)
                kept = [accept(x.as_py() or "", None if (n := v.as_py()) is None else int(n)) for x, v in zip(batch.column(at), values)]
            yield batch.filter(pa.array(kept, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
