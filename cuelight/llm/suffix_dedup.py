"""Suffix-array dedup: removal of every byte in a string of 100 bytes that also starts earlier in the corpus.

A window is a string of `LENGTH` bytes. Its anchor is its least gram of GRAM bytes by hash, so that equal windows
have equal anchors at equal places. Neighbouring windows with the same anchor form a run, about 1 / 40 of the bytes.
Runs of equal content are settled by hash, each content for itself: all but the earliest are repeats, most of them
before any shuffle, since a task keeps the earliest of what it meets again and again. Runs with the same anchor and
other content, which is where repeats begin and end, go to the shard of their anchor. A suffix array of a shard's runs, by induced sorting, and
its permuted common prefixes give the classes of equal windows there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import chunks, lean, modest_batches, prefix_hash, span_hash, split_by_sketch, text_bytes, written
from cuelight.llm.suffix_array import permuted_common_prefixes, suffix_array

LENGTH, GRAM = 100, 24
#: Runs that a task holds back to settle them against its next documents; bounds memory, not results.
HELD_RUNS = 1 << 14
#: Parts of an anchor's contents, one bit each, that are joined apart with what is known of the anchor.
SALTS = 64
#: Anchors with more contents than this are split by the bytes beside the anchor, for windows that hold those.
HOT_CONTENTS = 1000
#: Text in one suffix array, but for a shard's single larger group.
SHARD_BYTES = 1 << 20
NULL_ID = -(2**63)

_ROWS = "kind byte, key long, content long, id long, twin long, start long, n int, off int"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
_TYPES = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
REPEAT, RUN, EDGE, HOT_EDGE = 0, 1, 2, 3


def _batch(kind, key, content, ids, twin, start, n, off) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x), t) for x, t in zip((kind, key, content, ids, twin, start, n, off), _TYPES, strict=True)], names=_NAMES)


def _merged(ids: np.ndarray, twin: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Repeats as rows, adjoining ones of a document as one; keyed by document so that they spread."""
    order = np.lexsort((start, twin, ids))
    ids, twin, start, n = ids[order], twin[order], start[order], n[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (twin[1:] != twin[:-1]) | (start[1:] > start[:-1] + n[:-1])
    begin = np.flatnonzero(new)
    total = np.maximum.reduceat(start + n, begin) - start[begin] if len(begin) else n[:0]
    zero = np.zeros(len(begin), np.int64)
    return _batch(zero + REPEAT, ids[begin], zero, ids[begin], twin[begin], start[begin], total, zero)


def first_least(x: np.ndarray, width: int) -> np.ndarray:
    """First place of the least number in each span of `width` unsigned numbers; there is one span at least."""
    wide = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    wide[: len(x)] = x
    blocks = wide.reshape(-1, width)
    until = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    least = np.minimum(since[:n], until[width - 1 : width - 1 + n])  # a span is the end of a block and the start of the next
    moved = np.ones(n, bool)  # elsewhere the place is that of the span before
    moved[1:] = (least[1:] != least[:-1]) | (x[: n - 1] == least[:-1])
    at = np.flatnonzero(moved)
    spans = np.lib.stride_tricks.sliding_window_view(x, width)
    place = np.concatenate([at[i : i + 4096] + spans[at[i : i + 4096]].argmin(axis=1) for i in range(0, len(at), 4096)])
    return np.repeat(place, np.diff(np.append(at, n)))


def find_runs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start, number of windows, anchor's place after the start, anchor and content hash of each run."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none, none
    sums = prefix_hash(raw)
    places = np.arange(n - GRAM + 1)
    grams = span_hash(sums, places, places + GRAM)
    anchor = first_least(grams, LENGTH - GRAM + 1)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    starts = np.flatnonzero(row[: n - LENGTH + 1] == row[LENGTH - 1 :])
    if not len(starts):
        return none, none, none, none, none, none
    a = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    s, e = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
    return row[s], s, e - s + 1, a[begin] - s, grams[a[begin]].view(np.int64), span_hash(sums, s, e + LENGTH).view(np.int64)


def _first_of_each(content: np.ndarray, ids: np.ndarray, twin: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the earliest row of each content, those of several rows last, and of rows that are later than it."""
    by = np.argsort(content)
    same = content[by[1:]] == content[by[:-1]]
    several = np.zeros(len(by), bool)
    several[1:] |= same
    several[:-1] |= same
    some = by[several]
    order = some[np.lexsort((start[some], twin[some], ids[some], content[some]))]
    new = np.ones(len(order), bool)
    new[1:] = content[order][1:] != content[order][:-1]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    later = (ids[order] != ids[first]) | (twin[order] != twin[first]) | (start[order] != start[first])
    return np.concatenate([np.sort(by[~several]), order[new]]), order[later]


def _run_rows(unique: bool) -> Callable:
    """Runs of texts. Contents that a task meets again are settled in it, so that a frequent one leaves it as one row."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 7
        for batch in chunks(batches):
            raw, at = text_bytes(batch.column("text"))
            row, s, n, off, key, content = find_runs(raw, at)
            if not len(row):
                continue
            doc = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)[row]
            text = np.zeros(len(row), np.int64) if unique else span_hash(prefix_hash(raw), at[:-1], at[1:]).view(np.int64)[row]
            every = [np.concatenate(x) for x in zip(held, (key, content, doc, text, s - at[row], n, off), strict=True)]
            _, content, ids, twin, start, n, _ = every
            first, later = _first_of_each(content, ids, twin, start)
            if len(later):
                yield _merged(ids[later], twin[later], start[later], n[later])
            gone = first[:-HELD_RUNS]  # older ones that were not met again
            if len(gone):
                yield _batch(np.full(len(gone), RUN), *(x[gone] for x in every))
            held = [x[first[-HELD_RUNS:]] for x in every]
        if len(held[0]):
            yield _batch(np.full(len(held[0]), RUN), *held)

    return lean(runs)


@lean
def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition by anchor and content: repeats of whole runs, and the earliest run of each content."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        kind = b.column("kind").to_numpy()
        if (kind == REPEAT).any():
            yield b.filter(pa.array(kind == REPEAT))
        held.append(b.filter(pa.array(kind == RUN)))
    if not held:
        return
    table = pa.Table.from_batches(held)
    del held
    every = [table.column(c).to_numpy() for c in _NAMES[1:]]
    _, content, ids, twin, start, n, _ = every
    first, later = _first_of_each(content, ids, twin, start)
    if len(later):
        yield _merged(ids[later], twin[later], start[later], n[later])
    if len(first):
        yield _batch(np.full(len(first), RUN), *(x[first] for x in every))


def _edges(settled: DataFrame) -> DataFrame:
    """Earliest runs whose anchor has other contents too, as EDGE or, beyond HOT_CONTENTS of them, HOT_EDGE.

    Contents are counted in part before the shuffle, and an anchor's runs are joined with the count in SALTS parts.
    """
    first = settled.filter(F.col("kind") == RUN)
    salt = F.pmod(F.col("content"), F.lit(SALTS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), salt)
    counted = first.groupBy("key").agg(F.count("*").alias("contents"), F.bit_or(bit).alias("salts")).filter("contents > 1")
    kind = F.when(F.col("contents") > HOT_CONTENTS, HOT_EDGE).otherwise(EDGE).alias("kind")
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.call_function("getbit", F.col("salts"), i) == 1)
    several = written(counted.select("key", kind, F.explode(parts).alias("salt")), "several-contents")
    maybe, _ = split_by_sketch(first, "key", several.select("key"))
    return maybe.drop("kind").withColumn("salt", salt).join(several, ["key", "salt"])


def _fetch(unique: bool) -> Callable:
    """Bytes of the runs that shards compare: (key, id, twin, start, n, bytes)."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            raw, at = text_bytes(batch.column("text"))
            own = np.zeros(batch.num_rows, np.int64) if unique else span_hash(prefix_hash(raw), at[:-1], at[1:]).view(np.int64)
            out: tuple[list, ...] = ([], [], [], [], [], [])

            def add(key, r, twin, start, n, lo, out=out, raw=raw):
                for x, v in zip(out, (key, ids[r], twin, start, n, raw[lo : lo + n + LENGTH - 1].tobytes()), strict=True):
                    x.append(v)

            ids, twins, edges = batch.column("id").to_pylist(), batch.column("twin").to_pylist(), batch.column("edges").to_pylist()
            for r in range(batch.num_rows):
                if twins[r] != own[r]:
                    continue  # another text of the same doc_id
                base = int(at[r])
                for e in edges[r]:
                    s, n, off = e["start"], e["n"], e["off"]
                    if e["kind"] == EDGE:
                        add(e["key"], r, twins[r], s, n, base + s)
                        continue
                    # Windows that hold the bytes left of the anchor, and those that hold the ones right of it.
                    half = (LENGTH - GRAM) // 2
                    a = base + s + off
                    mid = min(s + n, max(s, s + off - half + 1))
                    for side, lo, hi, span in ((b"left", s, mid, raw[a - half : a + GRAM]), (b"right", mid, s + n, raw[a : a + GRAM + half])):
                        if lo < hi:
                            sub = hashlib.blake2b(span.tobytes(), digest_size=8, salt=side).digest()
                            add(int.from_bytes(sub, "little", signed=True), r, twins[r], lo, hi - lo, base + lo)
            if out[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:5]), pa.array(out[5], pa.binary())], names=["key", "id", "twin", "start", "n", "bytes"])

    return lean(fetch)


def shard_repeats(texts: list[bytes], ids: np.ndarray, twin: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run index and place of each window in `texts` that equals an earlier one, earlier by (id, twin, start).

    Every text is one run: its windows start at all places with LENGTH bytes to come.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts])
    base = np.cumsum(sizes) - sizes
    sa = suffix_array(data)
    run = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(data)) - base[run]
    valid = inside <= sizes[run] - LENGTH
    sa = sa[valid[sa]]
    prefixes = permuted_common_prefixes(data, sa, LENGTH)
    classes = np.cumsum(prefixes[sa] < LENGTH)
    where = start[run[sa]] + inside[sa]
    _, later = _first_of_each(classes, ids[run[sa]], twin[run[sa]], where)
    return run[sa[later]], inside[sa[later]]


@lean
def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among runs of the same key; rows come sorted by key and groups share suffix arrays up to SHARD_BYTES."""
    held: list[tuple] = []
    group: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            ids, twin, start = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 3))
            run, place = shard_repeats([h[5] for h in held], ids, twin, start)
            if len(run):
                yield _merged(ids[run], twin[run], start[run] + place, np.ones(len(run), np.int64))

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "twin", "start", "n", "bytes")), strict=True):
            if group and group[0][0] != row[0]:
                if len(group) > 1:
                    held += group
                    size += sum(len(g[5]) for g in group)
                group = []
                if size > SHARD_BYTES:
                    yield from flush()
                    held, size = [], 0
            group.append(row)
    if len(group) > 1:
        held += group
    yield from flush()


def _digest(unique: bool, with_kept: bool) -> Callable:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            raw, at = text_bytes(batch.column("text"))
            own = np.zeros(batch.num_rows, np.int64) if unique else span_hash(prefix_hash(raw), at[:-1], at[1:]).view(np.int64)
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for r, (i, repeats) in enumerate(zip(batch.column("id").to_pylist(), batch.column("repeats").to_pylist(), strict=True)):
                text = raw[at[r] : at[r + 1]]
                removed = spans = 0
                kept = text.tobytes()
                mine = sorted((p["start"], p["start"] + p["n"] + LENGTH - 1) for p in repeats or [] if p["twin"] == own[r])
                if mine:
                    parts, done, a, b = [], 0, *mine[0]
                    for x, y in [*mine[1:], (len(kept) + 1, len(kept) + 1)]:
                        if x <= b:
                            b = max(b, y)
                            continue
                        parts.append(kept[done:a])
                        done, removed, spans = b, removed + b - a, spans + 1
                        a, b = x, y
                    kept = b"".join([*parts, kept[done:]])
                for x, v in zip(out, (None if i == NULL_ID else i, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None), strict=True):
                    x.append(v)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            types = [*[pa.int64()] * 4, pa.string(), pa.binary()]
            keep = 6 if with_kept else 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out[:keep], types[:keep], strict=True)], names=names[:keep])

    return lean(digest)


def remove_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans and kept_sha256; `with_kept` adds the bytes.

    A byte goes if a string of LENGTH bytes over it also starts earlier: in a document with a smaller doc_id or
    before in the same one. A null text is empty; texts shorter than LENGTH stay whole; a null doc_id is the
    smallest. Different texts that share a doc_id are ordered by a hash of the text; rows that are equal in both
    count as one document and get the same result. Other columns are ignored. Runs and grams are compared by 64-bit
    hashes, windows of shards byte by byte.
    """
    modest_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), "text")
    unique = rows.groupBy("id").count().filter("count > 1").limit(1).count() == 0
    runs = rows.select(F.col("id").alias("doc_id"), "text").mapInArrow(_run_rows(unique), _ROWS)
    settled = written(runs.repartition("key", "content").mapInArrow(_settle, _ROWS), "settled-runs")
    edges = _edges(settled).groupBy("id", "twin").agg(F.collect_list(F.struct("key", "start", "n", "off", "kind")).alias("edges"))
    edges = written(edges, "edge-runs")
    maybe, _ = split_by_sketch(rows, "id", edges.select("id"))
    fetched = maybe.join(edges, "id").mapInArrow(_fetch(unique), "key long, id long, twin long, start long, n long, bytes binary")
    beside = fetched.repartition("key").sortWithinPartitions("key").mapInArrow(_shards, _ROWS)
    found = settled.filter(F.col("kind") == REPEAT).unionByName(beside)
    repeats = written(found.groupBy("id").agg(F.collect_list(F.struct("twin", "start", "n")).alias("repeats")), "repeats")
    maybe, clean = split_by_sketch(rows, "id", repeats.select("id"))
    none = clean.withColumn("repeats", F.lit(None).cast(repeats.schema["repeats"].dataType))
    every = maybe.join(repeats, "id", "left").unionByName(none.select("id", "text", "repeats"))
    return every.mapInArrow(_digest(unique, with_kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
