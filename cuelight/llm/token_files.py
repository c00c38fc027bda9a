"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back by memory map.

Layout of one dataset folder in shared storage:

* ``part-*.ids``   token ids, little-endian, uint16 where the vocabulary allows it, else uint32
* ``part-*.off``   uint64, one more than the part's documents: where each document starts in the part
* ``part-*.doc``   int64 document ids in the same order (a null id is the smallest int64)
* ``MANIFEST.json`` parts in document order with their bases, the prefix sums of the parts' lengths

A part is written under a name of its own by every task attempt; only the names that successful attempts
return enter the manifest, so a lost executor leaves at most unreferenced files.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.llm.common import chunks, lean, modest_batches, shared_dir, worker_state, written

PARTS = "path string, first_id long, first_key long, n_docs long, n_tokens long"
PART_NAMES = [x.split()[0] for x in PARTS.split(", ")]
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
NULL_ID = -(2**63)

#: Bytes of words and ids that a worker keeps, and text and words that it takes apart at a time; these bound memory, not results.
CACHE_BYTES, STEP_BYTES, STEP_WORDS = 32 << 20, 2 << 20, 1 << 18
#: Words handed to the tokenizer in one text, with a mark between them whose id no other word can have.
JOINED, MARK = 100, "\x01"


def _pick(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The spans of ids that begin at `starts` and hold `counts` of them, end to end."""
    place = np.cumsum(counts) - counts
    return ids[np.repeat(starts - place, counts) + np.arange(int(counts.sum()))]


class WordEncoder:
    """Encodes through the tokenizers library, once per distinct word.

    Holds for vocabularies whose pre-tokenizer drops white space and never joins across it, so that a text's
    ids are its words' ids in turn; `by_word=False` hands over whole texts for any other vocabulary. Words are split
    at ASCII space alone: what other space a word holds is left to the tokenizer. Words, and which of them are known,
    are told apart by Arrow's exact hash tables.
    """

    def __init__(self, path: str, dtype: str, by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.by_word = Tokenizer.from_file(path), np.dtype(dtype), by_word
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.words, self.ids, self.starts, self.counts = pa.array([], pa.large_string()), np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text, end to end, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.array([len(x) for x in got], np.int64)
        return np.fromiter((i for x in got for i in x), self.dtype, int(counts.sum())), counts

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words, many in one text."""
        ids, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), JOINED):
            some = words[k : k + JOINED]
            if self.mark is not None and not any(MARK in w for w in some):
                got = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, np.int64)
                cut = np.flatnonzero(got == self.mark)
                if len(cut) == len(some) - 1:
                    ids.append(got[got != self.mark].astype(self.dtype))
                    counts.append(np.diff(np.concatenate([[-1], cut, [len(got)]])) - 1)
                    continue
            some_ids, some_counts = self._whole(some)
            ids.append(some_ids)
            counts.append(some_counts)
        return np.concatenate(ids), np.concatenate(counts)

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these distinct words start in self.ids, and how many each has; new words are added."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        at = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        if len(new):
            ids, counts = self._new(new.to_pylist())
            if self.words.nbytes + new.nbytes + 16 * len(self.words) + self.ids.nbytes > CACHE_BYTES:  # begin anew with the words at hand
                have = at[at >= 0]
                self.ids, self.counts = _pick(self.ids, self.starts[have], self.counts[have]), self.counts[have]
                self.words, self.starts = words.filter(pa.array(at >= 0)), np.cumsum(self.counts) - self.counts
                at[at >= 0] = np.arange(len(have))
            at[at < 0] = len(self.words) + np.arange(len(new))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            self.words = pa.concat_arrays([self.words, new])
        return self.starts[at], self.counts[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text of a string column, end to end, and how many each has; null has none."""
        texts = texts.fill_null("").cast(pa.large_string())
        if not self.by_word:
            return self._whole(texts.to_pylist())
        split = pc.ascii_split_whitespace(texts)
        words, ends = split.flatten(), np.diff(split.offsets.to_numpy()).cumsum()
        ids, lengths = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), STEP_WORDS):
            coded = words.slice(k, STEP_WORDS).dictionary_encode()
            starts, counts = self._known(coded.dictionary)
            which = coded.indices.to_numpy()
            lengths.append(counts[which])
            ids.append(_pick(self.ids, starts[which], lengths[-1]))
        before = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        return np.concatenate(ids), np.diff(before[np.concatenate([[0], ends])])


def id_type(vocabulary: str, end_id: int) -> str:
    """The least unsigned type that holds every id of the vocabulary and the end id."""
    from tokenizers import Tokenizer

    return "uint16" if max(Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "uint32"


def _local(path: str) -> str:
    """The mounted path of a file: URI; other stores need a mount for memory maps."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if re.match(r"\w+://", path):
        raise ValueError(f"memory-mapped token files need a mounted folder, not {path}")
    return path


def _writer(folder: str, vocabulary: str, end_id: int, dtype: str, by_word: bool) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("tokens", vocabulary, dtype, by_word), lambda: WordEncoder(vocabulary, dtype, by_word))
        base = f"{_local(folder)}/part-{uuid.uuid4().hex}"
        total, docs, first = 0, 0, None
        out = None
        try:
            for batch in chunks(batches, limit=STEP_BYTES):
                if out is None:
                    os.makedirs(_local(folder), exist_ok=True)
                    out = [open(f"{base}.{x}", "wb") for x in ("ids", "off", "doc")]  # noqa: SIM115
                    out[1].write(np.zeros(1, "<u8").tobytes())
                    first = (batch.column("doc_id")[0].as_py(), batch.column("text_key")[0].as_py())
                ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                coded, counts = encoder.encode(batch.column("text"))
                coded = np.insert(coded, np.cumsum(counts), end_id)
                ends = total + np.cumsum(counts + 1, dtype=np.uint64)
                out[0].write(coded.astype(np.dtype(dtype).newbyteorder("<")).tobytes())
                out[1].write(ends.astype("<u8").tobytes())
                out[2].write(ids.astype("<i8").tobytes())
                total, docs = int(ends[-1]), docs + len(ids)
        finally:
            for f in out or []:
                f.close()
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([base]), *(pa.array([x], pa.int64()) for x in (*first, docs, total))], names=PART_NAMES)

    return lean(write)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, dtype: str | None = None, by_word: bool = True) -> str:
    """Encode docs(doc_id, text) in ascending doc_id order to a dataset folder and return that folder.

    Null and empty texts are one end id; null doc_ids come first; rows that share a doc_id stay separate
    documents, ordered by a hash of the text, and may lie in several parts; other columns are ignored; an empty table
    gives a manifest without parts. `dtype` is the least type that holds the vocabulary unless given.
    """
    spark = modest_batches(docs.sparkSession)
    folder, dtype = folder or shared_dir(spark, "token-files"), dtype or id_type(vocabulary, end_id)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "text")
    parts = written(ordered.mapInArrow(_writer(folder, vocabulary, end_id, dtype, by_word), PARTS), "token-parts")
    base, listed = 0, []
    for p in sorted(parts.collect(), key=lambda p: (p.first_id is not None, p.first_id or 0, p.first_key)):  # a row per output file
        listed.append({"path": os.path.basename(p.path), "base": base, "n_docs": p.n_docs, "n_tokens": p.n_tokens})
        base += p.n_tokens
    _commit(spark, f"{folder}/MANIFEST.json", json.dumps({"dtype": dtype, "end_id": end_id, "n_tokens": base, "parts": listed}, indent=1))
    return folder


def _commit(spark: SparkSession, path: str, body: str) -> None:
    """Write under a passing name, then rename: readers see the whole manifest or none."""
    jvm = spark._jvm
    target, passing = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(passing, False)
    out.write(bytearray(body.encode()))
    out.close()
    if not fs.rename(passing, target):
        raise OSError(f"{path} could not be committed")


def _read(dtype: str, folder: str, with_ids: bool) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                base = f"{_local(folder)}/{part['path']}"
                ids = np.memmap(f"{base}.ids", np.dtype(dtype).newbyteorder("<"), "r")
                at = np.memmap(f"{base}.off", "<u8", "r").astype(np.int64)
                doc = np.memmap(f"{base}.doc", "<i8", "r")
                for k in range(0, len(doc), 4096):
                    own, ends = at[k : k + 4097], slice(k, k + 4096)
                    texts = [ids[a:b].astype("<u4") for a, b in zip(own[:-1], own[1:], strict=True)]
                    out = {
                        "doc_id": pa.array([None if d == NULL_ID else d for d in doc[ends].tolist()], pa.int64()),
                        "start": pa.array(own[:-1] + part["base"]),
                        "n_tokens": pa.array(np.diff(own)),
                        "ids_crc32": pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([t.tolist() for t in texts], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    return lean(read)


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """The committed manifest of a dataset folder."""
    lines = spark.read.text(f"{folder}/MANIFEST.json", wholetext=True).collect()
    return json.loads(lines[0].value)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document of a dataset: doc_id, start, n_tokens and ids_crc32 (of its ids as little-endian uint32).

    `with_ids` adds the ids themselves as an array.
    """
    manifest = read_manifest(spark, folder)
    rows = [(p["path"], p["base"]) for p in manifest["parts"]]
    parts = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return parts.mapInArrow(_read(manifest["dtype"], folder, with_ids), ROWS + (", ids array<long>" if with_ids else ""))


def token_files(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write docs as token files and return what a reader finds in them."""
    return read_token_files(docs.sparkSession, write_token_files(docs, vocabulary, end_id))
