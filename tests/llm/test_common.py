import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelight.llm import common as C


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t漢", max_size=12)), max_size=8))
def test_word_spans_and_hashes(texts):
    raw, at = C.text_bytes(pa.array(texts, pa.string()))
    starts, ends, first = C.word_spans(raw, at, C.not_space())
    got = [[bytes(raw[s:e]) for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [(t or "").encode().split() for t in texts]
    hashes = C.span_hash(C.prefix_hash(raw), starts, ends).tolist()
    words = [w for row in got for w in row]
    assert len(set(zip(words, hashes, strict=True))) == len(set(words)) == len(set(hashes))


def test_chunks_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 0, 50, 3, 3)] + [None], "k": list(range(6))})
    parts = list(C.chunks([batch, batch.slice(0, 0)], limit=8))
    assert [p.column("k").to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5]]


def test_sketch_loses_no_key(spark, monkeypatch):
    monkeypatch.setattr(C, "SKETCH_BITS", 1 << 7)
    df = spark.range(500).withColumnRenamed("id", "k")
    maybe, never = C.split_by_sketch(df, "k", df.filter("k % 50 = 0"))
    there, gone = {r.k for r in maybe.collect()}, {r.k for r in never.collect()}
    assert not there & gone and len(there | gone) == 500 and {k for k in range(0, 500, 50)} <= there and len(gone) > 300


def test_clear_passing(spark):
    df = C.written(spark.range(3).toDF("a"), "passing")
    assert df.count() == 3 and C.clear_passing(spark) >= 1
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(*df.inputFiles()).count()


def test_powers():
    up, down = C.powers(10)
    assert (up * down == np.ones(10, np.uint64)).all()
