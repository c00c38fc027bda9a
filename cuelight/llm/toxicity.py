"""Toxicity by compression distance: one zstandard dictionary from toxic and one from ordinary text.

A window is a framed word, with the digits and marks inside it, after a fixed carrier phrase; training text is framed
alike, so that a match may run over a word's ends. It is compressed with the ordinary dictionary and with the toxic
one, which share nothing. What the toxic one saves, with the window's length, puts it into a bucket, once with a wide
frame and once with a narrow one. Labelled documents calibrate the threshold: a regularised logistic model over the
buckets' counts.

The ordinary dictionary is trained on whole ordinary documents, the toxic one on what remains of toxic documents
without the words that ordinary documents use about as often. Trained on whole toxic documents, which are ordinary
text for the most part, both dictionaries hold nearly the same: README has the figures.

Bounds, all of the fit alone: FIT_DOCS documents of either class and FIT_BYTES of text come to the driver, chosen by
hash of the doc_id; SAMPLE_BYTES of them, in order of that hash, train the ordinary dictionary; dictionaries have
ORDINARY_BYTES and TOXIC_BYTES. Scores cover every word of every text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelight.llm.common import chunks, lean, modest_batches, worker_state
from cuelight.llm.fitting import held_out, labelled

#: Labelled documents of either class that the model is fitted on at most, and their text in all.
FIT_DOCS, FIT_BYTES = 6000, 24 << 20
ORDINARY_BYTES, TOXIC_BYTES = 24 << 10, 12 << 10
#: Ordinary text that its dictionary is trained on at most, some hundred times the dictionary's size.
SAMPLE_BYTES = 4 << 20
#: Words that stay in toxic training text are in so many toxic documents, as a share and at least, and so much likelier there.
TOXIC_SHARE, TOXIC_LEAST, TOXIC_ODDS = 0.012, 3, 8.0
#: Words before each window and before training text's own; those that most ordinary documents use.
CARRIED = 12
WINDOW_BYTES = 48
LEVEL = 12
MIN_GAIN, MAX_GAIN, MAX_LENGTH = -6, 9, 14
N_BUCKETS = (MAX_GAIN - MIN_GAIN + 1) * (MAX_LENGTH + 1)
#: Bytes of words kept per worker with their buckets, and what one takes besides its letters; bounds memory, not results.
CACHE_BYTES, WORD_BYTES = 32 << 20, 170

#: Marks around each word, in windows as in training text. Wide ones favour whole words, narrow ones beginnings.
FRAMES = ((b"<<<<", b">>>>"), (b"<<", b">>"))
RIDGE = 0.1

_WORDS = re.compile(rb"[a-z0-9\x80-\xff](?:[^\s]*[a-z0-9\x80-\xff])?")


def windows(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text, from their first to their last letter or digit; long ones in pieces."""
    words = _WORDS.findall((text or "").encode().lower())
    if any(len(w) > WINDOW_BYTES for w in words):
        return [w[i : i + WINDOW_BYTES] for w in words for i in range(0, len(w), WINDOW_BYTES)]
    return words


@dataclass
class Model:
    """Per frame: ordinary and toxic dictionary and carrier phrase; a weight for each bucket, then for length, then the offset."""

    dictionaries: list[tuple[bytes, bytes, bytes]]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FRAMES) * N_BUCKETS + 2))

    def key(self) -> int:
        """Tells models apart in a worker."""
        return hash((*self.dictionaries, self.weights.tobytes()))


class Buckets:
    """Buckets of windows under a model's two dictionaries; one per worker and model."""

    def __init__(self, model: Model):
        import zstandard

        def compressor(content: bytes):
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=len(content), min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=trained, compression_params=params).compress

        self.known: dict[bytes, int] = {}
        self.held = 0
        self.frames = [(carrier + left, right, compressor(ordinary), compressor(toxic)) for (left, right), (ordinary, toxic, carrier) in zip(FRAMES, model.dictionaries, strict=True)]

    def bucket(self, w: bytes) -> int:
        """Buckets of a window under all frames, as one number."""
        code = 0
        for before, after, ordinary, toxic in self.frames:
            window = before + w + after
            gain = len(ordinary(window)) - len(toxic(window))
            code = code * N_BUCKETS + (min(MAX_GAIN, max(MIN_GAIN, gain)) - MIN_GAIN) * (MAX_LENGTH + 1) + min(MAX_LENGTH, len(w))
        return code

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) counts, frame by frame, and the number of windows of each text."""
        known = self.known
        rows, codes = [], []
        for text in texts:
            ws = windows(text)
            if self.held > CACHE_BYTES:
                known.clear()
                self.held = 0
            for w in ws:
                if w not in known:
                    known[w] = self.bucket(w)
                    self.held += len(w) + WORD_BYTES
            rows.append(len(ws))
            codes += [known[w] for w in ws]
        n = np.array(rows, np.int64)
        code, out = np.array(codes, np.int64), []
        for _ in FRAMES:
            code, own = np.divmod(code, N_BUCKETS)
            at = np.repeat(np.arange(len(texts)) * N_BUCKETS, n) + own
            out.append(np.bincount(at, minlength=len(texts) * N_BUCKETS).reshape(len(texts), N_BUCKETS))
        return np.concatenate(out[::-1], 1), n


def features(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log counts of the buckets, log length and a constant."""
    return np.concatenate([np.log1p(counts), np.log1p(n)[:, None], np.ones((len(n), 1))], 1)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content that zstandard picks from the samples; all of them where they fit, or their end if there is no choice."""
    import zstandard

    whole = b"".join(samples)
    if len(whole) <= size or len(samples) < 8:
        return whole[-size:]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-(size - 1024) :]  # without its entropy tables
    except zstandard.ZstdError:  # too little variety to train on
        return whole[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Ridge logistic weights by damped Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_texts(texts: list[str | None], labels: np.ndarray) -> Model:
    """A model from labelled texts."""
    seen, one, words = set(), {}, []
    for t in texts:
        words.append([] if t in seen else [one.setdefault(w, w) for w in windows(t)])  # copies would lend their words weight
        seen.add(t)
    used = [Counter(), Counter()]
    for ws, y in zip(words, labels.tolist(), strict=True):
        used[y].update(set(ws))
    n = [max(1, sum(1 for ws, y in zip(words, labels.tolist(), strict=True) if ws and y == k)) for k in (0, 1)]
    odds = lambda w: (used[1][w] + 0.5) / (n[1] + 1) / ((used[0][w] + 0.5) / (n[0] + 1))
    telling = {w for w, c in used[1].items() if c >= max(TOXIC_LEAST, TOXIC_SHARE * n[1]) and odds(w) > TOXIC_ODDS}
    carried = [w for w, _ in sorted(used[0].items(), key=lambda x: (-x[1], x[0]))[:CARRIED]]
    dictionaries = []
    for left, right in FRAMES:
        sentence = lambda ws, left=left, right=right: b"".join(left + w + right for w in ws)
        toxic, ordinary, room = [], [], SAMPLE_BYTES
        for ws, y in zip(words, labels.tolist(), strict=True):
            if y:
                toxic.append(sentence([w for w in ws if w in telling]))
            elif ws and room > 0:
                ordinary.append(sentence(ws))
                room -= len(ordinary[-1])
        carrier = sentence(carried)
        trained = (_dictionary(ordinary, ORDINARY_BYTES), _dictionary([x for x in toxic if x] * 8, TOXIC_BYTES))  # repeats: the trainer wants more text than words need
        dictionaries.append((*(x + carrier for x in trained), carrier))
    model = Model(dictionaries)
    del words, one, used, seen
    if len(set(labels.tolist())) < 2:
        model.weights[-1] = 4.0 if labels.sum() else -4.0
        return model
    buckets = Buckets(model)
    x = [features(*buckets.counts(texts[i : i + 256])) for i in range(0, len(texts), 256)]
    model.weights = _logistic(np.concatenate(x), labels.astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS, limit_bytes: int = FIT_BYTES) -> Model:
    """A model from labels.toxic of documents that aren't held out.

    At most about `limit` documents of either class, and `limit_bytes` of text, come to the driver.
    """
    chosen = labelled(docs, labels, "toxic", limit, limit_bytes)
    got = sorted(chosen.select("doc_id", "text", "toxic").collect(), key=lambda r: (zlib.crc32(f"fit:{r.doc_id}".encode()), r.doc_id, r.text or ""))
    return fit_texts([r.text for r in got], np.array([r.toxic for r in got], int))


def _scorer(shared, key: int, name: str | None, threshold: float) -> Callable:
    """Batches with the score as column `name`, or only their rows that score below the threshold."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        buckets = worker_state(("toxicity", key), lambda: Buckets(model))
        for batch in chunks(batches):
            x = features(*buckets.counts(batch.column("text").to_pylist())) @ model.weights
            p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            yield batch.filter(pa.array(p < threshold)) if name is None else pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, name])

    return lean(score)


def score_toxicity(docs: DataFrame, model: Model, name: str = "_toxicity") -> DataFrame:
    """docs with column `name`, the probability that a whole text is toxic; it replaces one of that name.

    Null and empty texts have no windows and get the score of that; repeated rows score alike; other columns stay; an
    empty table stays so.
    """
    docs = docs.drop(name)
    shared = modest_batches(docs.sparkSession).sparkContext.broadcast(model)
    return docs.mapInArrow(_scorer(shared, model.key(), name, 0), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold under a model of the labels, with all their columns as they are.

    Null and empty texts stay unless the model finds texts without words toxic; rows with a null doc_id and rows that
    share one are judged by their own text; repeated rows stay or go together; extra columns may have any name; an
    empty table, or one without labels, loses nothing.
    """
    model = fit(docs, labels)
    shared = modest_batches(docs.sparkSession).sparkContext.broadcast(model)
    return docs.mapInArrow(_scorer(shared, model.key(), None, threshold), docs.schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (1 from 0.5 on)."""
    out = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"))
