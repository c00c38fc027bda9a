"""Quality classifier: Naive Bayes support vectors.

Indicators of hashed n-grams are scaled by their class log-count ratios and a linear hinge-loss model is fitted to
them by dual coordinate descent. Three kinds of n-grams: byte trigrams of the whole text, case kept, words and pairs of
words, and n-grams of shape symbols, where each word is written as its case and marks and as whether the text had it before. Shape n-grams
also stand for their share of the text, in steps of 2, so that a habit counts apart from a single use.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelight.llm.common import chunks, lean, mix, modest_batches, not_space, prefix_hash, span_hash, text_bytes, word_spans
from cuelight.llm.fitting import held_out, labelled, logistic, platt

#: Labelled documents of either class that the model is fitted on at most.
FIT_DOCS = 5000
#: Text of these documents at most; beyond it fewer of them are taken.
FIT_BYTES = 24 << 20
BITS = 18
COST, ROUNDS = 1.0, 30

_WORD = not_space()
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _hashed(x: np.ndarray, kind: int) -> np.ndarray:
    return (mix(x.astype(np.uint64) * np.uint64(64) + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)


def _counts(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[ends] - total[starts]


def indicators(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and n-gram buckets, each pair once, of a text column; a text without words has none."""
    raw, at = text_bytes(column)
    starts, ends, first = word_spans(raw, at, _WORD)
    n_rows, n = len(at) - 1, len(starts)
    row = np.repeat(np.arange(n_rows), np.diff(first))
    sizes = np.diff(at)
    pairs = []
    # Byte trigrams within a text.
    if len(raw) > 2:
        gram = (raw[:-2].astype(np.uint64) << np.uint64(16)) | (raw[1:-1].astype(np.uint64) << np.uint64(8)) | raw[2:]
        of = np.repeat(np.arange(n_rows), sizes)
        same = of[:-2] == of[2:]
        pairs.append(of[:-2][same] << BITS | _hashed(gram[same], 0))
    if n:
        words = span_hash(prefix_hash(raw), starts, ends)
        length = ends - starts
        upper, lower, digit = (_counts(t[raw], starts, ends) for t in (_UPPER, _LOWER, _DIGIT))
        marks = length - upper - lower - digit
        # Is the word in the text already, and is it the one before?
        order = np.lexsort((np.arange(n), words, row))
        again = np.zeros(n, bool)
        again[order[1:]] = (words[order[1:]] == words[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
        twin = np.zeros(n, bool)
        twin[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
        shape = (np.where(upper > 1, 2, upper) + 3 * np.minimum(marks, 3) + 12 * (digit > 0) + 24 * (lower > 0)).astype(np.uint64)
        repeat = (again.astype(np.uint64) + twin).astype(np.uint64)
        count = np.maximum(1, np.diff(first))
        pairs.append(row << BITS | _hashed(words, 50))
        same = row[1:] == row[:-1]
        pairs.append(row[1:][same] << BITS | _hashed(mix(words[:-1][same]) + words[1:][same], 51))
        streams = [(shape, 1), (repeat, 4)]
        for symbols, kind in streams:
            gram = symbols
            for order_n in range(3):
                if order_n:
                    gram = gram[:-1] * np.uint64(64) + symbols[order_n:]
                m = len(gram)
                if m <= 0:
                    break
                same = row[:m] == row[order_n : order_n + m]
                key = row[:m][same] << BITS | _hashed(gram[same], kind + order_n)
                there, times = np.unique(key, return_counts=True)
                share = np.floor(-np.log2(times / count[there >> BITS])).astype(np.int64)
                pairs.append(there)
                for step in range(8):  # a thermometer: shares of at least 1/2, 1/4, ...
                    have = there[share <= step]
                    pairs.append((have >> BITS) << BITS | _hashed((have & ((1 << BITS) - 1)).astype(np.uint64), 16 + step))
        pairs.append(np.arange(n_rows)[np.diff(first) > 0] << BITS | _hashed(np.minimum(10, np.log2(count[np.diff(first) > 0])).astype(np.uint64), 40))
    both = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Model:
    """A weight for each bucket (log-count ratio times hinge weight), the ratios' squares, the offset and the calibration curve."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    curve: tuple[float, float]


def dual_descent(index: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = COST, rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise |w|^2 / 2 + cost * sum of hinge losses, one dual variable at a time.

    Each class has the same total cost. y is -1 or 1; the offset is a feature that is always 1.
    """
    n = len(y)
    upper = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) * cost
    alpha, w, b = np.zeros(n), np.zeros(size), 0.0
    square = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(n).tolist():
            g = y[i] * (w[index[i]] @ values[i] + b) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), upper[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[index[i]] += step * y[i] * values[i]
                b += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, b


def margins(rows: np.ndarray, buckets: np.ndarray, n: int, weights: np.ndarray, squares: np.ndarray, bias: float) -> np.ndarray:
    """Margins of n documents' vectors of scaled indicators, each of unit length as in training; without n-grams the offset."""
    norm = np.sqrt(np.bincount(rows, squares[buckets], minlength=n))
    return np.bincount(rows, weights[buckets], minlength=n) / np.maximum(1e-9, norm) + bias


def _train(index: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    size = 1 << BITS
    count = {k: np.ones(size) for k in (-1, 1)}
    for f, k in zip(index, y.tolist(), strict=True):
        count[k][f] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[-1] / count[-1].sum())
    values = []
    for f in index:
        v = ratio[f]
        values.append(v / max(1e-9, np.sqrt(v @ v)))
    w, b = dual_descent(index, values, y, size)
    return w * ratio, ratio**2, b


def fit_indicators(index: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model from each document's buckets; the curve is fitted to margins of folds left out."""
    size = 1 << BITS
    y = np.where(labels > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size), np.zeros(size), 0.0, (1.0, 4.0 if (y > 0).any() else -4.0))
    left = np.zeros(len(y))
    folds = np.random.default_rng(0).integers(0, 3, len(y))
    for k in range(3):
        train = [i for i in range(len(y)) if folds[i] != k]
        if len({int(y[i]) for i in train}) < 2:
            continue
        fitted = _train([index[i] for i in train], y[train])
        for i in np.flatnonzero(folds == k):
            left[i] = margins(np.zeros(len(index[i]), np.int64), index[i], 1, *fitted)[0]
    return Model(*_train(index, y), platt(left, (y > 0).astype(float)))


@lean
def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        rows, buckets = indicators(batch.column("text"))
        cut = np.searchsorted(rows, np.arange(1, batch.num_rows))
        packed = [x.astype("<i4").tobytes() for x in np.split(buckets, cut)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "buckets": pa.array(packed, pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS, limit_bytes: int = FIT_BYTES) -> Model:
    """A model from labels.quality of documents that aren't held out, about `limit` of either class at most."""
    chosen = labelled(docs, labels, "quality", limit, limit_bytes)
    got = sorted(chosen.mapInArrow(_indexer, "doc_id long, quality int, buckets binary").collect(), key=lambda r: (r.doc_id, bytes(r.buckets)))
    return fit_indicators([np.frombuffer(r.buckets, "<i4") for r in got], np.array([r.quality for r in got], int))


def _scorer(shared) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chunks(batches):
            rows, buckets = indicators(batch.column("text"))
            n = batch.num_rows
            margin = margins(rows, buckets, n, model.weights, model.squares, model.bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logistic(margin, model.curve))], names=[*batch.schema.names, "_quality"])

    return lean(score)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _quality, the probability that a whole text is good.

    A null or empty text has no n-grams and gets the probability of the offset; repeated rows score alike.
    """
    docs = docs.drop("_quality")
    shared = modest_batches(docs.sparkSession).sparkContext.broadcast(model)
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema.fields], T.StructField("_quality", T.DoubleType())])
    return docs.mapInArrow(_scorer(shared), schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (1 from 0.3 on)."""
    out = score_quality(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_quality").alias("score"), (F.col("_quality") >= 0.3).cast("int").alias("predicted"))
