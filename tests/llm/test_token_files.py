import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuelight.llm import token_files as token_files_module
from cuelight.llm.token_files import WordEncoder, read_manifest, read_token_files, token_files, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, path string"


def brute(rows):
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


ROWS = [(5, "The quick  brown\nfox's <|endoftext|> jumps"), (3, None), (9, ""), (3, "same id"), (None, "no id"), (7, "é é ß İ ΑΣ 漢字 \x1c a\x1cb !!"), (8, "long " * 3000), (10, "x" * 5000), (11, "long " * 3000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], SCHEMA).repartition(3)
    got = sorted(map(tuple, token_files(df, PATH, 2).collect()), key=lambda r: r[1])
    assert got == brute(ROWS)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    folder = write_token_files(df, PATH, 2)
    assert read_manifest(spark, folder)["parts"] == [] and token_files(df, PATH, 2).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
@pytest.mark.parametrize("encoder", [WordEncoder(PATH, "uint16")])
def test_words_are_texts(encoder, text):
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    ids, counts = encoder.encode(pa.array([text, None, text]))
    assert counts.tolist() == [len(want), 0, len(want)] and ids.tolist() == want * 2


def test_known_words_are_dropped_when_full(monkeypatch):
    monkeypatch.setattr(token_files_module, "CACHE_BYTES", 400)
    encoder, whole = WordEncoder(PATH, "uint16"), Tokenizer.from_file(PATH)
    for k in range(30):
        texts = [f"word{k} the {w} same {k % 3} \x01 <|endoftext|>a\x01" for w in ("alpha", "beta", None, "")]
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        ids, counts = encoder.encode(pa.array(texts))
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


def test_type_follows_vocabulary(spark, tmp_path):
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    tokenizer = Tokenizer(WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0"))
    tokenizer.pre_tokenizer = Whitespace()
    tokenizer.save(str(tmp_path / "large.json"))
    df = spark.createDataFrame([(1, "w69999 w5"), (2, None)], "doc_id long, text string")
    folder = write_token_files(df, str(tmp_path / "large.json"), 2)
    assert read_manifest(spark, folder)["dtype"] == "uint32"
    assert [r.ids for r in read_token_files(spark, folder, with_ids=True).orderBy("start").collect()] == [[69999, 5, 2], [2]]


def test_one_id_for_many_rows(spark):
    rows = [(None, f"text {i}") for i in range(400)] + [(4, f"text {i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = token_files(df, PATH, 2).collect()
    whole = Tokenizer.from_file(PATH)
    crc = lambda t: zlib.crc32(np.array([*whole.encode(t).ids, 2], "<u4").tobytes())
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in got) == sorted((i or 0, crc(t)) for i, t in rows)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()] and [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: i or 0)
