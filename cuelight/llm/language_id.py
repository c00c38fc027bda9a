"""Language identification: script ranges narrow the candidates of each word, Viterbi labels the spans.

A word's score for a language is the log probability of its byte trigrams under that language. Languages that do
not write a word's script are no candidates for it. Viterbi over the words, with a penalty for each switch of
language, gives spans; the language whose spans hold most letters is the document's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import CHUNK_BYTES, chunks, lean, lower_ascii, mix, text_bytes, word_spans
from cuelight.llm.fitting import held_out, sample_by

#: Labelled documents that the model is fitted on at most.
FIT_DOCS = 20_000
BUCKETS = 1 << 16
#: Cost in nats of a change of language between two words.
SWITCH = 12.0
#: Share of a language's words that a script needs for the language to be a candidate there.
SCRIPT_SHARE = 0.02

UND = "und"
#: Scripts by first code point of each range, up to the next one's. A word's script is that of its first
#: character beyond ASCII, Latin where there is none; signs and marks that many scripts share count as Latin.
RANGES = """
latin 0000; greek 0370; cyrillic 0400; armenian 0530; hebrew 0590; arabic 0600; syriac 0700; arabic 0750; thaana 0780; other 07C0;
arabic 0870; devanagari 0900; bengali 0980; gurmukhi 0A00; gujarati 0A80; oriya 0B00; tamil 0B80; telugu 0C00; kannada 0C80;
malayalam 0D00; sinhala 0D80; thai 0E00; lao 0E80; tibetan 0F00; burmese 1000; georgian 10A0; hangul 1100; ethiopic 1200;
cherokee 13A0; other 1400; khmer 1780; mongolian 1800; other 18B0; khmer 19E0; other 1A00; cyrillic 1C80; georgian 1C90; other 1CC0; latin 1D00;
greek 1F00; latin 2000; other 2C00; latin 2C60; other 2C80; georgian 2D00; other 2D30; ethiopic 2D80; cyrillic 2DE0; latin 2E00; han 2E80; latin 3000;
kana 3040; han 3100; hangul 3130; han 3190; kana 31F0; han 3200; other A000; cyrillic A640; other A6A0; latin A700; other A800; hangul A960;
other A980; ethiopic AB00; latin AB30; other AB70; hangul AC00; other D800; han F900; latin FB00; armenian FB13; hebrew FB1D; arabic FB50;
latin FE00; arabic FE70; latin FEFF; kana FF66; hangul FFA0; latin FFE0; other 10000; kana 1B000; other 1B170; latin 1F000; han 20000; other 40000
"""
_FIRST = np.array([int(x.split()[1], 16) for x in RANGES.split(";")])
NAMES = list(dict.fromkeys(x.split()[0] for x in RANGES.split(";")))
_OF_RANGE = np.array([NAMES.index(x.split()[0]) for x in RANGES.split(";")], np.int16)

_LOWER = lower_ascii()
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Model:
    """Languages, their trigram log probabilities (bucket, language) and the scripts they write (script, language)."""

    languages: list[str]
    log_p: np.ndarray
    writes: np.ndarray


def _trigrams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each byte, with a blank at a word's ends."""
    left = np.zeros(len(low), np.uint64)
    right = np.zeros(len(low), np.uint64)
    left[1:], right[:-1] = low[:-1], low[1:]
    left[starts] = 1
    right[ends - 1] = 1
    return (mix((left << np.uint64(16)) | (low.astype(np.uint64) << np.uint64(8)) | right) >> np.uint64(48)).astype(np.int64)


def _code_points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters beyond ASCII that begin at these bytes."""
    byte = lambda k: raw[np.minimum(at + k, len(raw) - 1)].astype(np.int64) & 0x3F
    lead = raw[at].astype(np.int64)
    two = (lead & 0x1F) << 6 | byte(1)
    three = (lead & 0x0F) << 12 | byte(1) << 6 | byte(2)
    four = (lead & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3)
    return np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, ends, words before each row, script of each word."""
    raw, at = text_bytes(column)
    low = _LOWER[raw]
    starts, ends, first = word_spans(low, at, _LETTER)
    script = np.zeros(len(starts), np.int16)
    if len(starts):
        beyond = np.flatnonzero(low >= 0xC2)
        hit = np.searchsorted(beyond, starts)
        ok = hit < len(beyond)
        where = beyond[np.minimum(hit, max(0, len(beyond) - 1))] if len(beyond) else np.zeros(len(starts), np.int64)
        ok &= where < ends
        script[ok] = _OF_RANGE[np.searchsorted(_FIRST, _code_points(low, where[ok]), "right") - 1]
    return low, starts, ends, first, script


def _counter(languages: list[str]) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {x: k for k, x in enumerate(languages)}
        for batch in chunks(batches):
            low, starts, ends, first, script = _words(batch.column("text"))
            if not len(starts):
                continue
            lang = np.array([known.get(x, -1) for x in batch.column("lang").to_pylist()])
            of_word = np.repeat(lang, np.diff(first))
            of_byte = np.repeat(of_word, ends - starts)
            inside = np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts) + np.arange(len(of_byte))
            grams = np.unique(of_byte * BUCKETS + _trigrams(low, starts, ends)[inside], return_counts=True)
            scripts = np.unique(of_word * len(NAMES) + script, return_counts=True)
            for kind, (slots, n) in (("gram", grams), ("script", scripts)):
                yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(slots), pa.string()), "slot": pa.array(slots, pa.int64()), "n": pa.array(n, pa.int64())})

    return lean(count)


def fit(docs: DataFrame, limit: int = FIT_DOCS) -> Model:
    """A model from text and non-null lang of docs that aren't held out, about `limit` of them at most;
    languages share these evenly, and one with few rows is taken whole.

    What comes to the driver are counts in a fixed number of buckets for each language; a model of L languages takes
    256 KB each there and in a worker. There may be 32,767 of them at most; more raise an error.
    """
    rows, languages = sample_by(docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), F.col("doc_id"), "lang", limit)
    k = len(languages)
    if k >= 1 << 15:
        raise ValueError(f"{k} languages; {(1 << 15) - 1} at most can be told apart")
    grams, scripts = np.zeros(k * BUCKETS, np.float32), np.zeros(k * len(NAMES))
    counts = rows.select("text", "lang").mapInArrow(_counter(languages), "kind string, slot long, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n"))
    if k:
        got = counts.toArrow()
        is_gram = np.array(got.column("kind").to_pylist()) == "gram"
        slot, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
        grams[slot[is_gram]] = n[is_gram]
        scripts[slot[~is_gram]] = n[~is_gram]
    grams, scripts = grams.reshape(k, BUCKETS), scripts.reshape(k, len(NAMES))
    log_p = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32)
    return Model(languages, np.ascontiguousarray(log_p), (scripts > SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))).T.copy())


def word_scores(model: Model, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, script: np.ndarray) -> np.ndarray:
    """(word, language) log probabilities; languages that don't write a word's script lose it by a wide margin."""
    buckets = _trigrams(low, starts, ends)
    out = np.empty((len(starts), len(model.languages)), np.float32)
    for j in range(len(model.languages)):
        total = np.concatenate([[0.0], np.cumsum(model.log_p[buckets, j], dtype=np.float64)])
        out[:, j] = total[ends] - total[starts]
    writes = model.writes[script]
    out[~writes & writes.any(1, keepdims=True)] -= 50.0
    out[~writes.any(1)] = 0.0  # a script that no language writes tells nothing
    return out - out.max(1, keepdims=True)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word, row by row, under a penalty for each switch; ties go to the earlier language.

    A row keeps its best single language where no run of words could gain a switch's cost, by a bound on the
    largest sum of gains over neighbouring words. All other rows advance together, a word of each at a step.
    """
    n, k = scores.shape
    path = np.zeros(n, np.int16)
    if k < 2 or not n:
        return path
    sums = np.concatenate([np.zeros((1, k)), np.cumsum(scores, 0, dtype=np.float64)])
    totals = sums[first[1:]] - sums[first[:-1]]
    best = totals.argmax(1)
    of_word = np.repeat(best, np.diff(first))
    path[:] = of_word
    gain = np.cumsum(scores.max(1) - scores[np.arange(n), of_word], dtype=np.float64)
    gain = np.concatenate([[0.0], gain])
    open_rows = np.flatnonzero(gain[first[1:]] - gain[first[:-1]] > switch)
    if not len(open_rows):
        return path
    others = scores - scores[np.arange(n), of_word][:, None]
    others[np.arange(n), of_word] = -np.inf
    rise = np.concatenate([[0.0], np.cumsum(others.max(1), dtype=np.float64)])
    hard = []
    for r in open_rows.tolist():
        p = rise[first[r] : first[r + 1] + 1]
        if (p - np.minimum.accumulate(p)).max() > switch:
            hard.append(r)
    if not hard:
        return path
    rows = np.array(hard)
    sizes = (first[1:] - first[:-1])[rows]
    rows = rows[np.argsort(-sizes, kind="stable")]
    sizes, begin = (first[1:] - first[:-1])[rows], first[:-1][rows]
    steps = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(steps), "left")
    back = np.full((n, k), -1, np.int16)
    value = scores[begin].astype(np.float64)
    for t in range(1, steps):
        m = int(active[t])
        at = begin[:m] + t
        v = value[:m]
        top = v.argmax(1)
        jump = v[np.arange(m), top] - switch
        stay = v >= jump[:, None]
        back[at] = np.where(stay, -1, top[:, None])
        value[:m] = np.where(stay, v, jump[:, None]) + scores[at]
    state = value.argmax(1)
    for t in range(steps - 1, -1, -1):
        m = int(active[t])
        at = begin[:m] + t
        path[at] = state[:m]
        prev = back[at, state[:m]]
        state[:m] = np.where(prev >= 0, prev, state[:m])
    return path


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _labeller(model: Model, with_spans: bool) -> Callable:
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.languages)
        for batch in chunks(batches, limit=max(1 << 14, CHUNK_BYTES * 8 // max(8, k))):  # scores are words by languages
            low, starts, ends, first, script = _words(batch.column("text"))
            n = batch.num_rows
            names, scores = [UND] * n, np.zeros(n)
            path = np.zeros(len(starts), np.int16)
            if k and len(starts):
                path = viterbi(word_scores(model, low, starts, ends, script), first)
                row = np.repeat(np.arange(n), np.diff(first))
                told = model.writes[script].any(1)  # words in scripts that some language writes
                letters = np.bincount(row * k + path, (ends - starts) * told, minlength=n * k).reshape(n, k)
                top, total = letters.argmax(1), np.bincount(row, ends - starts, minlength=n)
                ascii_letter = np.bincount(row, ((low[starts] < 0x80) | (low[ends - 1] < 0x80)), minlength=n) > 0
                texts = None
                for r in np.flatnonzero(total).tolist():
                    if not ascii_letter[r]:
                        texts = texts or batch.column("text").to_pylist()
                        if not _has_letter(texts[r]):
                            continue
                    names[r] = model.languages[top[r]]
                    scores[r] = letters[r, top[r]] / total[r]
            out = {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)}
            if with_spans:
                out["spans"] = pa.array([_spans(path[a:b], model.languages) for a, b in zip(first[:-1], first[1:], strict=True)], pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])))
            yield pa.RecordBatch.from_pydict(out)

    return lean(label)


def _spans(path: np.ndarray, languages: list[str]) -> list[dict]:
    if not len(path):
        return []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
    return [{"lang": languages[path[a]], "first_word": int(a), "n_words": int(b - a)} for a, b in zip(cut[:-1], cut[1:], strict=True)]


def identify(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, lang_pred and score, the share of letters in spans of lang_pred.

    `with_spans` adds the labelled spans, in words (runs of letters). Null texts and texts without a letter are
    'und' with score 0, and so is everything where no language was learned. Words in scripts that
    no learned language writes count for no language, so that a text of them alone gets the first language with score 0. Repeated rows are labelled alike; other columns are ignored.
    """
    spans = ", spans array<struct<lang: string, first_word: int, n_words: int>>"
    return docs.select("doc_id", "text").mapInArrow(_labeller(model, with_spans), "doc_id long, lang_pred string, score double" + spans * with_spans)


def language_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score under a model of the rows that aren't held out."""
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
