"""Readers and writers of the tables around the engine."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _schema(spec: str) -> T.StructType:
    kinds = {"s": _S, "i": _I, "l": _L, "b": _B, "a": T.ArrayType(_S), "v": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


CUE = _schema("cue_id:s show_id:s season:i episode:i release_group:s source_path:s cue_index:i start_ms:l end_ms:l timestamp_display:s speaker:s text_raw:s text_original:s text_clean:s is_watermark:b detected_language:s was_translated:b")
CHUNK = _schema("chunk_id:s show_id:s show_title:s season:i episode:i cue_index:i start_ms:l end_ms:l speaker:s text_line:s text_clean:s text_embed:s context_before:a context_after:a token_count_line:i token_count_embed:i")
AUDIT = _schema("path:s season:i episode:i release_group:s status:s file_size_bytes:l cue_count:i dialogue_cue_count:i duration_ms:l has_watermark:b parse_error_count:i error_message:s")
MANIFEST = _schema("show_id:s season:i episode:i episode_id:s release_group:s subtitle_path:s audit_status:s detected_language:s was_translated:s cue_count:l dialogue_cue_count:l chunk_count:l verified:s")
EVAL_QUERY = _schema("query_id:s query:s expected_episode_id:s expected_season:i expected_episode:i expected_cue_contains:s category:s notes:s variant_of:s variant_type:s")
EVENT = _schema("ts:s type:s query:s top_k:i latency_ms:i result_count:i top_chunk_ids:a chunk_id:s vote:s rank:i show_id:s show_title:s episode_label:s")
SHOW = T.StructType([*_schema("show_id:s show_title:s media_type:s imdb_id:s seasons:i episodes_total:i").fields, T.StructField("season_episodes", T.ArrayType(_I))])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per line; blank lines are skipped and missing fields are null."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object per line, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_events(df: DataFrame, path: str) -> None:
    """Append rows to an event log."""
    write_jsonl(df, path, "append")


def read_json_map(spark: SparkSession, path: str, field: str, value: str) -> DataFrame:
    """Entries of the object under `field` of a whole-file JSON document: key and value of the given type."""
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.explode(F.from_json("value", f"struct<`{field}`: map<string, {value}>>")[field]).alias("key", "value"))


def read_manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """CSV with a header; columns that the file lacks are null, columns in any order."""
    df = spark.read.csv(path, header=True)
    return df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header, in the given order; booleans read True and False."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    df.select([F.initcap(F.col(c).cast("string")).alias(c) if kinds[c] == "boolean" else c for c in columns]).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_report(report: DataFrame, path: str) -> str:
    """One row as indented JSON in a driver's file, and as a Markdown table in what it returns."""
    row = json.loads(report.toJSON().first())
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row, f, indent=2, ensure_ascii=False)
    return "\n".join(["| metric | value |", "|---|---|", *(f"| {k} | {json.dumps(v, ensure_ascii=False)} |" for k, v in row.items())])


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Rows of .npy matrices as (path, pos, embedding); a file's rows come in slices, without the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                matrix = np.load(io.BytesIO(content))
                for k in range(0, len(matrix), 4096):
                    part = matrix[k : k + 4096].astype(np.float32)
                    yield pa.RecordBatch.from_pydict({"path": [name] * len(part), "pos": pa.array(range(k, k + len(part)), pa.int64()), "embedding": pa.array(list(part), pa.list_(pa.float32()))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "path string, pos long, embedding array<float>")


def expand_episodes(shows: DataFrame) -> DataFrame:
    """(show_id, season, episode) of a catalog: by season_episodes, else the total split evenly, first seasons first."""
    even = F.transform(F.sequence(F.lit(1), F.col("seasons")), lambda s: (F.floor(F.col("episodes_total") / F.col("seasons")) + F.when(s <= F.col("episodes_total") % F.col("seasons"), 1).otherwise(0)).cast("int"))
    known = F.when(F.size(F.coalesce("season_episodes", F.array().cast("array<int>"))) > 0, F.col("season_episodes")).otherwise(F.when(F.col("seasons") > 0, even))
    per = shows.select("show_id", F.posexplode(known).alias("s", "n")).filter("n > 0")
    return per.select("show_id", (F.col("s") + 1).alias("season"), F.explode(F.sequence(F.lit(1), "n")).alias("episode"))


def load_env(path: str) -> None:
    """KEY=VALUE lines, with export and quotes allowed, into unset environment variables."""
    if not os.path.isfile(path):
        return
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            key, eq, value = line.removeprefix("export ").partition("=")
            if eq and not line.startswith("#") and key.strip():
                value = value.strip()
                quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
                os.environ.setdefault(key.strip(), value[1:-1] if quoted else value)


def valid_request(query: Column, top_k: Column) -> Column:
    """Is a search request within limits: a query of 1 to 500 characters and 1 to 10 results?"""
    return F.coalesce(F.length(query).between(1, 500) & top_k.between(1, 10), F.lit(False))


def valid_feedback(query: Column, chunk: Column, vote: Column, rank: Column) -> Column:
    """Is a vote within limits? A missing rank is allowed."""
    ok = F.length(query).between(1, 500) & F.length(chunk).between(1, 200) & vote.isin("up", "down") & (rank.isNull() | rank.between(1, 10))
    return F.coalesce(ok, F.lit(False))
