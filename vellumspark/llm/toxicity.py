"""Toxicity by cumulative-link ordinal regression: severity grades from sparse text features.

P(grade <= k | x) = sigmoid(t_k - w.x): one weight vector is shared by all ordered thresholds t_0 < t_1 < ..., and the
expected severity is the sum over k of P(grade > k). Features are the distinct lower-cased words of a text, stripped of
punctuation, and their beginnings (compounds share them); those with a clear tie to toxic labels in the fitting sample
get weights (at most VOCABULARY features).

The labels know two classes only. Grades are derived in fitting: 0 for rows not labelled toxic; a row labelled toxic has
grade 1, 2 or 3 by the number of different marked features that it holds (up to 4, up to 12, more). Fitted on the driver on
at most ``rows`` labelled documents (TRAIN_ROWS, a documented bound); every document is scored, whole.

Defined results: null text counts as empty and has the severity of no features; null labels don't count; several labels
of one document are averaged; without labels of both classes every expected severity is 0; ties, repeated rows and
extra columns have no effect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import LOWER, crc_mod, give_back, texts
from vellumspark.llm.quality_fm import filter_rows, labelled

GRADES = 4
TRAIN_ROWS = 12000
VOCABULARY = 4096
#: A feature is marked from this document count and z value of its log odds on.
LEAST_DOCS, LEAST_Z = 8, 5.0
#: Bytes of a word's beginnings.
BEGINNINGS = (4, 5, 6)
#: Grade borders by different marked features: more than 4 is grade 2, more than 12 is grade 3.
BORDERS = (4, 12)
STEPS, RATE, L2 = 400, 0.5, 1e-4
PUNCTUATION = b".,;:!?\"'()[]{}*#%&$|-_"


def features_of(text: str) -> set[bytes]:
    """The distinct words, and their beginnings behind a byte 1, which no word holds before its end."""
    words = {w.strip(PUNCTUATION) for w in text.encode("utf-8", "surrogatepass").translate(LOWER).split()}
    words.discard(b"")
    return words.union(*({b"\1" + w[:n] for w in words if len(w) > n} for n in BEGINNINGS))


def hashes_of(text: str) -> np.ndarray:
    """XXH64 of the features, ascending."""
    import xxhash

    found = features_of(text)
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    """weights by word hash; thresholds in ascending order. No thresholds: nothing was learned, all severities are 0."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def above(self, text: str) -> np.ndarray:
        """P(grade > k) for each k."""
        if not len(self.thresholds):
            return np.zeros(GRADES - 1)
        import xxhash

        get = self.weights.get
        z = math.fsum(get(h, 0.0) for h in map(xxhash.xxh64_intdigest, features_of(text)))
        return _sigmoid(z - self.thresholds)


def fit(rows: list[np.ndarray], toxic: np.ndarray) -> Model:
    """Gradient descent on the ordinal log likelihood; thresholds are kept in order by positive steps. Rows: hashes_of()."""
    n1 = int(toxic.sum())
    n0 = len(rows) - n1
    if not n0 or not n1:
        return Model({}, np.zeros(0))
    words, df = np.unique(np.concatenate(rows), return_counts=True)
    marked, c = np.unique(np.concatenate([x for x, y in zip(rows, toxic) if y]), return_counts=True)
    df = df[np.searchsorted(words, marked)]
    del words
    p, q = (c + 0.5) / (n1 + 1), (df - c + 0.5) / (n0 + 1)
    z = (np.log(p / (1 - p)) - np.log(q / (1 - q))) / np.sqrt(1 / (c + 0.5) + 1 / (df - c + 0.5))
    gain = c * np.log(p / q)
    good = (df >= LEAST_DOCS) & ((z >= LEAST_Z) | ((df == c) & (gain >= LEAST_Z * LEAST_DOCS / 2)))
    vocabulary = np.sort(marked[good][np.lexsort((marked[good], -gain[good]))][:VOCABULARY])
    if not len(vocabulary):
        return Model({}, np.zeros(0))
    pairs = [(k, np.searchsorted(vocabulary, x[np.isin(x, vocabulary)])) for k, x in enumerate(rows)]
    r = np.concatenate([np.full(len(x), k, np.int64) for k, x in pairs])
    j = np.concatenate([x for _, x in pairs]).astype(np.int64)
    held = np.bincount(r, minlength=len(rows))
    grade = np.where(toxic > 0, 1 + np.searchsorted(BORDERS, held, side="left"), 0)
    weights, first, steps = np.zeros(len(vocabulary)), 2.0, np.zeros(GRADES - 2)
    memory = [np.full(len(vocabulary), 1e-6), 1e-6, np.full(GRADES - 2, 1e-6)]
    for _ in range(STEPS):
        t = first + np.concatenate([[0], np.cumsum(np.exp(steps))])
        z = np.bincount(r, weights[j], len(rows))
        low = np.where(grade > 0, _sigmoid(np.concatenate([[0], t])[grade] - z), 0)
        high = np.where(grade < GRADES - 1, _sigmoid(np.concatenate([t, [0]])[grade] - z), 1)
        p = np.maximum(high - low, 1e-9)
        dl, dh = low * (1 - low) / p / len(rows), high * (1 - high) / p / len(rows)
        d_z = dh - dl  # of the negative log likelihood
        d_t = np.bincount(grade, -dh, GRADES)[: GRADES - 1] + np.bincount(grade, dl, GRADES)[1:]
        grads = [np.bincount(j, d_z[r], len(vocabulary)) + L2 * weights, float(d_t.sum()), np.array([d_t[k + 1 :].sum() for k in range(GRADES - 2)]) * np.exp(steps)]
        for k, g in enumerate(grads):
            memory[k] = 0.9 * memory[k] + 0.1 * g * g
        weights -= RATE * 0.2 * grads[0] / np.sqrt(memory[0] + 1e-12)
        first -= RATE * 0.2 * grads[1] / math.sqrt(memory[1] + 1e-12)
        steps -= RATE * 0.2 * grads[2] / np.sqrt(memory[2] + 1e-12)
    return Model(dict(zip(vocabulary.tolist(), weights.tolist())), first + np.concatenate([[0], np.cumsum(np.exp(steps))]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from rows whose crc32 of the id is not 1 modulo 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes_of(x.as_py()).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(found, pa.binary())], names=["doc_id", "y", "words"])

    sample = labelled(docs, labels, "toxic", crc_mod("doc_id", 3) != 1, rows)
    got = sample.mapInArrow(run, "doc_id long, y double, words binary").toArrow().sort_by([("doc_id", "ascending"), ("words", "ascending")])
    model = fit([np.frombuffer(x, np.uint64) for x in got["words"].to_pylist()], (np.array(got["y"].to_pylist(), float) >= 0.5).astype(int))
    del got
    give_back()
    return model


def severities(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity, grade (the likeliest), toxic (grade 0 is less likely than the others together)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = np.array([shared.value.above(x.as_py()) for x in batch.column(1)]).reshape(-1, GRADES - 1)
            each = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
            columns = [batch.column(0), pa.array(above.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0] > 0.5)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "expected_severity", "grade", "toxic"])

    return texts(docs).mapInArrow(run, "doc_id long, expected_severity double, grade int, toxic boolean")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """severities() of every row, with held_out: the row was not learned from."""
    return severities(docs, train(docs, labels)).withColumn("held_out", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns; scored in place, so nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return filter_rows(docs, lambda text: not shared.value.above(text)[0] > 0.5)
