"""Benchmark decontamination by a generalised suffix automaton over normalised test items.

Training tokens stream through the automaton, which tracks the longest suffix that occurs in any item. Where that
length reaches the window, the last `window` words are a contaminated span and the state names the items. Items
shorter than the window count as one window of their own length.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelight.llm.common import chunks, free_name, lean, lower_ascii, modest_batches, prefix_hash, span_hash, text_bytes, word_spans, worker_state, written

WINDOW = 10
#: Words of items in one automaton: what a worker holds at once. More items are passed over in further rounds.
BLOCK_WORDS = 200_000
#: A document that is contaminated beyond this share of its words goes; below it only the spans go.
MAX_COVERAGE = 0.5

_LOWER = lower_ascii()
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def normalised_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, word starts, word ends, words before each row and word hashes of a text column."""
    raw, at = text_bytes(column)
    low = _LOWER[raw]
    starts, ends, first = word_spans(low, at, _INSIDE)
    return at, starts, ends, first, span_hash(prefix_hash(low), starts, ends)


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items that each state's substrings occur in."""

    def __init__(self, items: list[np.ndarray], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for item in items:
            last, path = 0, []
            for w in item.tolist():
                last = self._extend(last, w)
                path.append(last)
            ends.append(path)
        n = len(self.next)
        self.items: list[set[int]] = [set() for _ in range(n)]
        own: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for k, item in enumerate(items):
            v = 0
            for w in item.tolist():  # states that prefixes of the item end in, after all clones
                v = self.next[v][w]
                u = v
                while u > 0 and k not in self.items[u]:
                    self.items[u].add(k)
                    u = self.link[u]
            if 0 < len(item) < window:
                own[v].append((len(item), k))
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        #: State of the suffix of window length, below each state.
        self.top = list(range(n))
        #: Whole short items that are suffixes: those of the state itself, with lengths, and those of its links.
        self.short: list[tuple] = [()] * n
        self.own = own
        for v in by_length:
            u = self.link[v]
            if self.length[u] >= window:
                self.top[v] = self.top[u]
            if u > 0:
                self.short[v] = (*self.short[u], *own[u])

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, set[int] | tuple[int, ...]]]:
        """(first word, end, items) of every window that ends somewhere in the words."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        v = size = 0
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                size = length[v]
            if w not in nxt[v]:
                continue
            v = nxt[v][w]
            size += 1
            if size >= window:
                yield i + 1 - window, i + 1, self.items[self.top[v]]
            for m, k in (*self.short[v], *self.own[v]):
                if m <= size:
                    yield i + 1 - m, i + 1, (k,)


class Scanner:
    """Finds the windows of a block of items in chunks of documents."""

    def __init__(self, ids: list[str], items: list[np.ndarray], window: int):
        self.ids = ids
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *items]))
        coded = [np.searchsorted(self.vocabulary, x).astype(np.int64) for x in items]
        self.automaton = SuffixAutomaton(coded, window)
        n = len(self.vocabulary)
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *[x[:-1] * n + x[1:] for x in coded]]))
        self.least = min([window, *(len(x) for x in items if len(x))])

    def scan(self, first: np.ndarray, words: np.ndarray) -> list[tuple[int, int, set[int]]]:
        """(first word, end, items) over a chunk's words.

        A match of m words is m - 1 pairs of neighbours that some item has: only such runs are streamed, as
        elsewhere the automaton's length stays below every window.
        """
        n = len(self.vocabulary)
        if not n or not len(words):
            return []
        at = np.minimum(np.searchsorted(self.vocabulary, words), n - 1)
        known = self.vocabulary[at] == words
        joined = known[:-1] & known[1:]
        edges = first[1:-1]
        joined[edges[(edges > 0) & (edges < len(words))] - 1] = False
        maybe = np.flatnonzero(joined)
        pair = at[maybe] * n + at[maybe + 1]
        if len(self.pairs):
            joined[maybe] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        begin = np.flatnonzero(known & np.concatenate([[True], ~joined]))
        end = np.flatnonzero(known & np.concatenate([~joined, [True]])) + 1
        long = end - begin >= self.least
        out = []
        for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            out += [(b + x, b + y, items) for x, y, items in self.automaton.stream(at[b:e].tolist())]
        return out


def _rows(found: list[tuple], first: np.ndarray) -> tuple[list[list[int]], list[set[int]]]:
    """Per row: merged word spans, flat and relative to the row, and items."""
    spans: list[list[int]] = [[] for _ in range(len(first) - 1)]
    items: list[set[int]] = [set() for _ in range(len(first) - 1)]
    rows = np.searchsorted(first, [f[0] for f in found], "right") - 1
    for (b, e, k), r in sorted(zip(found, rows.tolist(), strict=True), key=lambda x: (x[0][0], x[0][1])):
        b, e = b - int(first[r]), e - int(first[r])
        if spans[r] and b <= spans[r][-1]:
            spans[r][-1] = max(spans[r][-1], e)
        else:
            spans[r] += [b, e]
        items[r].update(k)
    return spans, items


def _merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for x, y in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and x <= out[-1]:
            out[-1] = max(out[-1], y)
        else:
            out += [x, y]
    return out


#: Names of the columns that mark_contamination() adds: words, spans and items.
MARKS = ("_dc_words", "_dc_spans", "_dc_items")


def _cut(text: str, spans: list[int], starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without the words of its spans; starts and ends are those of its words, in bytes."""
    raw, kept, done = text.encode(), [], 0
    for b, e in zip(spans[::2], spans[1::2], strict=True):
        kept.append(raw[done : int(starts[b])])
        done = int(ends[e - 1])
    return b"".join([*kept, raw[done:]]).decode()


def _marker(block, key: str, names: tuple[str, str, str], max_coverage: float | None) -> Callable:
    """Adds a block's findings to those of the columns `names`; with `max_coverage` returns what is left of the rows instead."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = worker_state(("benchmark", key), lambda: Scanner(*block.value))
        for batch in chunks(batches):
            at, starts, ends, first, words = normalised_words(batch.column("text"))
            spans, items = _rows(scanner.scan(first, words), first)
            before = batch.column(names[1]).to_pylist(), batch.column(names[2]).to_pylist()
            spans = [_merged(a or [], b) for a, b in zip(before[0], spans, strict=True)]
            total = np.diff(first)
            own, columns = batch.schema.names[:-3], batch.columns[:-3]
            if max_coverage is None:
                items = [sorted({*(a or []), *(scanner.ids[k] for k in b)}) for a, b in zip(before[1], items, strict=True)]
                found = [pa.array(total, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, *found], names=[*own, *names])
                continue
            hit = np.array([sum(s[1::2]) - sum(s[::2]) for s in spans], np.int64)
            keep = hit <= max_coverage * total
            dirty = np.flatnonzero(keep & (hit > 0)).tolist()
            if dirty:
                texts = batch.column("text").to_pylist()
                for r in dirty:
                    its = slice(int(first[r]), int(first[r + 1]))
                    texts[r] = _cut(texts[r], spans[r], starts[its] - at[r], ends[its] - at[r])
                columns = [pa.array(texts, pa.string()) if c == "text" else x for c, x in zip(own, columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=own).filter(pa.array(keep))

    return lean(mark)


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Items with words, in blocks of about `limit` words; one block at a time is on the driver."""
    ids, items, total = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        words = normalised_words(pa.array([row.text or ""]))[4]
        if not len(words):
            continue
        if total and total + len(words) > limit:
            yield ids, items
            ids, items, total = [], [], 0
        ids.append("null" if row.item_id is None else row.item_id)
        items.append(words)
        total += len(words)
    yield ids, items


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, names: tuple[str, str, str], max_coverage: float | None) -> DataFrame:
    """A pass over docs for each block of items; the last one cuts if `max_coverage` is given."""
    modest_batches(docs.sparkSession)
    types = T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in [*docs.schema.fields, *map(T.StructField, names, types)]])
    empty = F.lit(0), F.array(), F.array()
    out = docs.select("*", *(e.cast(t).alias(n) for e, t, n in zip(empty, types, names, strict=True)))
    blocks = _blocks(benchmark, block_words)
    block = next(blocks)
    while block is not None:
        ids, items = block
        block = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast((ids, items, window))
        if block is None and max_coverage is not None:
            return out.mapInArrow(_marker(shared, uuid.uuid4().hex, names, max_coverage), docs.schema)
        out = out.mapInArrow(_marker(shared, uuid.uuid4().hex, names, None), schema)
        out = out if block is None else written(out, "marked")
    return out


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with _dc_words, _dc_spans (flat first and end words of contaminated runs) and _dc_items (sorted distinct item_ids).

    Null and empty texts have no words; null and empty items have no windows; a null item_id reads "null"; items
    that share an item_id count once. Rows that share a doc_id are scanned one by one, other columns stay, but for
    those of the three names. Item text may be of any size: beyond `block_words` the documents are passed over again.
    """
    return _passes(docs.drop(*MARKS), benchmark, window, block_words, MARKS, None)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without contaminated spans; documents with more than `max_coverage` of their words in spans go.

    What stands between words stays, so that the text around a span is untouched, and clean rows pass as they
    are, null texts too. Extra columns may have any name. See mark_contamination() for the other cases.
    """
    words, spans, items = (free_name(docs, n) for n in MARKS)
    return _passes(docs, benchmark, window, block_words, (words, spans, items), max_coverage)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, as mark_contamination() finds them."""
    marked = mark_contamination(docs.select("doc_id", "text"), benchmark, window)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = batch.column("_dc_spans").to_pylist(), batch.column("_dc_items").to_pylist()
            hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": batch.column("_dc_words"), "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), "contaminated": pa.array([h > 0 for h in hit]),
            })

    return marked.select("doc_id", "_dc_words", "_dc_spans", "_dc_items").mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


#: DuckDB: the same counts by joining windows.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, s.m, array_to_string(w[i + 1 : i + s.m], ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(greatest(len(w) - m + 1, 0))) AS i FROM d, (SELECT DISTINCT m FROM bw)) s),
hit AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
