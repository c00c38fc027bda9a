"""Shared folders, materialised intermediates and vectorised byte kernels."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of the size, shingle and quality contracts.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Text handed to a byte kernel at a time, which bounds a Python worker's memory.
CHUNK_BYTES = 500_000

_WORKER_STATE: dict = {}


def worker_state(key, make: Callable):
    """What a Python worker keeps between tasks, such as words it knows: made once and let go when another is asked for."""
    if key not in _WORKER_STATE:
        _WORKER_STATE.clear()
        _WORKER_STATE[key] = make()
    return _WORKER_STATE[key]


def release() -> None:
    """Give memory that Python, Arrow and the C library hold but don't use back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of rows that Spark hands to a Python worker at a time, unless the session says otherwise.
BATCH_BYTES = 4 << 20


def modest_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches bounded in bytes: rows are whole texts, and 10,000 of them are a lot.

    Batches take memory on both sides of the pipe, in the JVM outside of its heap. A lower bound that the session has
    stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def lean(function: Callable) -> Callable:
    """A function of batches for mapInArrow() that releases what it doesn't need when its last batch is through.

    Workers outlive tasks and stages: what one keeps would add to the next one's peak.
    """

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return run


def free_name(df: DataFrame, name: str) -> str:
    """`name`, made longer until df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the place that the session names for all machines.

    spark.checkpoint.dir is that place; it is set here only where nothing has set it, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = have.get() if have.isDefined() else None
        if base is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = "file://" + tempfile.mkdtemp(prefix="cuelight-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tables that this process has written on the way to a result.
_PASSING: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later readers survive lost executors and reuse the work."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    _PASSING.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_passing(spark: SparkSession) -> int:
    """Delete the tables of written(), once no result that reads them is needed; returns how many."""
    n = len(_PASSING)
    while _PASSING:
        p = spark._jvm.org.apache.hadoop.fs.Path(_PASSING.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return n


#: Bits of the sketch of keys that a join needs. Its size is fixed: a full one only lets more rows through.
SKETCH_BITS = 1 << 23


def split_by_sketch(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose key may be among wanted(key), and rows whose key isn't.

    The sketch is a bitmap of hashed keys, SKETCH_BITS / 64 words at most however many keys there are, so that it
    can go to all workers. A join of the first part then shuffles few rows in vain.
    """
    slot = lambda: F.pmod(F.xxhash64(F.col(key)), F.lit(SKETCH_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot() % 64).cast("int"))
    words = wanted.select(F.floor(slot() / 64).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    tested = df.withColumn("_word", F.floor(slot() / 64)).join(F.broadcast(written(words, "sketch")), "_word", "left")
    hit = F.coalesce(F.col("_bits"), F.lit(0)).bitwiseAND(bit) != 0
    return tested.filter(hit).select(df.columns), tested.filter(~hit).select(df.columns)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's offsets; null is empty."""
    column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `limit` bytes of text; one longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total, first = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(first, i - first)
                total, first = 0, i
            total += int(n)
        if first < batch.num_rows:
            yield batch.slice(first)


def lower_ascii() -> np.ndarray:
    """Byte table that lower-cases A-Z alone."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def not_space() -> np.ndarray:
    """Byte table of the bytes that belong to a word [^\\x20\\x09-\\x0D]+."""
    table = np.ones(256, bool)
    table[[32, *range(9, 14)]] = False
    return table


def word_spans(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each row; no word crosses rows."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    m = inside[raw]
    first = m.copy()
    first[1:] &= ~m[:-1]
    edge = at[:-1][at[:-1] < len(raw)]
    first[edge] = m[edge]
    last = m.copy()
    last[:-1] &= ~m[1:]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] = m[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2**64."""
    while len(_powers[0]) < n:
        for k, base in enumerate((_B, _B_INV)):
            have = _powers[k]
            step = np.uint64(pow(int(base), len(have), 1 << 64))
            _powers[k] = np.concatenate([have, have * step])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() gives the hash of any span."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal bytes have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
