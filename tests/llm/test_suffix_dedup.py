import hashlib
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelight.llm import suffix_dedup
from cuelight.llm.common import prefix_hash, span_hash, text_bytes
from cuelight.llm.suffix_array import permuted_common_prefixes, suffix_array
from cuelight.llm.suffix_dedup import GRAM, LENGTH, find_runs, remove_repeats

SCHEMA = "doc_id long, text string, id string, key string"


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80) | st.text(alphabet="ab", max_size=120).map(str.encode) | st.lists(st.sampled_from([b"abcab", b"zz", b"a"]), max_size=30).map(b"".join))
def test_suffix_array(data):
    array = np.frombuffer(data, np.uint8)
    sa = suffix_array(array)
    assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    common = permuted_common_prefixes(array, sa, 9)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
        k = 0
        while k < 9 and max(a, b) + k < len(data) and data[a + k] == data[b + k]:
            k += 1
        assert common[b] == k


@given(st.lists(st.integers(0, 6) | st.just(2**64 - 1), min_size=1, max_size=60), st.integers(1, 12))
def test_first_least(values, width):
    width = min(width, len(values))
    got = suffix_dedup.first_least(np.array(values, np.uint64), width)
    assert got.tolist() == [i + min(range(width), key=lambda k: values[i + k]) for i in range(len(values) - width + 1)]


def brute(docs, length):
    seen, out = {}, []
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    for i in order:
        data = (docs[i][1] or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.setdefault(data[s : s + length], i)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((docs[i][0], len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, docs = text(150), []
    for i in range(120):
        kind = i % 6
        if kind == 0 or len(docs) < 6:
            t = text(rng.randrange(600))
        elif kind == 1:
            t = text(rng.randrange(90)) + passage[rng.randrange(60) :] + text(rng.randrange(90))
        elif kind == 2:
            t = docs[rng.randrange(len(docs))][1]
        elif kind == 3:
            t = list(docs[rng.randrange(len(docs))][1])
            for _ in range(3):
                if t:
                    t[rng.randrange(len(t))] = "x"
            t = "".join(t)
        elif kind == 4:
            t = ("line of text that repeats, " * rng.randrange(12)) + "q" * rng.randrange(300)
        else:
            a, b = rng.choice(docs)[1], rng.choice(docs)[1]
            t = a[rng.randrange(len(a) + 1) :] + b[: rng.randrange(len(b) + 1)]
        docs.append((i * 3 % 121, t))
    return [*docs, (500, None), (501, ""), (None, docs[1][1]), (502, "y" * 30_000), (503, docs[0][1] * 40)]


def check(spark, docs):
    df = spark.createDataFrame([(*d, "clash", "clash") for d in docs], SCHEMA).repartition(3)
    got = remove_repeats(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, suffix_dedup.LENGTH)


def test_like_brute_force(spark):
    check(spark, corpus())


def test_split_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTENTS", 1)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
    check(spark, corpus(2))


def test_frequent_contents_leave_a_task_once():
    """A line of every chunk is one run row of a task, and what a task can't hold is left to the shuffle."""
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefgh") for _ in range(100))
    texts = [line + "".join(rng.choice("ijklmnop") for _ in range(3000)) for _ in range(30)]
    whole = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]}) for i, t in reversed(list(enumerate(texts)))]
    for held in (50, 1 << 14):
        suffix_dedup.HELD_RUNS, before = held, suffix_dedup.HELD_RUNS
        try:
            rows = pa.Table.from_batches(suffix_dedup._run_rows(True)(iter(whole))).to_pylist()
        finally:
            suffix_dedup.HELD_RUNS = before
        contents = {}
        for r in rows:
            if r["kind"] == suffix_dedup.RUN:
                contents.setdefault(r["content"], []).append(r)
        every = {}
        for i, t in enumerate(texts):
            _, s, n, _, _, content = find_runs(*text_bytes(pa.array([t])))
            for a, k, c in zip(s.tolist(), n.tolist(), content.tolist(), strict=True):
                every.setdefault(c, []).append((i, a, k))
        assert contents.keys() == every.keys()
        for c, got in every.items():
            assert min((r["id"], r["start"], r["n"]) for r in contents[c]) == min(got)
            if held > 50:
                assert len(contents[c]) == 1


def test_shared_ids_and_empty_table(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh") for _ in range(400))
    rows = [(1, text), (1, text), (1, text + " other"), (2, text)]
    got = sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_kept=True).collect()))
    assert len(got) == 4 and got[3][:4] == (2, 400, 400, 1) and got[3][5] == b""
    twins = [g for g in got if g[1] == 400 and g[0] == 1]
    assert twins[0] == twins[1] and {g[2] for g in got[:3]} in ({0, 400}, {400, 0})
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_anchors_do_not_depend_on_what_surrounds_them():
    """A window has the same anchor in a short chunk as in a long one, with whole hashes that differ late."""
    rng = np.random.default_rng(3)
    own = rng.integers(97, 123, 400).astype(np.uint8)
    wide = np.concatenate([rng.integers(97, 123, 30_000).astype(np.uint8), own, rng.integers(97, 123, 30_000).astype(np.uint8)])
    _, s, n, off, key, content = find_runs(own, np.array([0, len(own)]))
    runs = {(int(x), int(y)): (int(o), int(k)) for x, y, o, k in zip(s, n, off, key, strict=True)}
    at = np.array([0, 30_000, 30_400, len(wide)])
    row, s2, n2, off2, key2, content2 = find_runs(wide, at)
    inner = row == 1
    assert {(int(x) - 30_000, int(y)): (int(o), int(k)) for x, y, o, k in zip(s2[inner], n2[inner], off2[inner], key2[inner], strict=True)} == runs
    assert content2[inner].tolist() == content.tolist()
    sums = prefix_hash(own)
    for x, y, o in zip(s.tolist(), n.tolist(), off.tolist(), strict=True):
        for w in range(x, x + y):
            grams = [int(span_hash(sums, np.array([g]), np.array([g + GRAM]))[0]) for g in range(w, w + LENGTH - GRAM + 1)]
            assert w + grams.index(min(grams)) == x + o
