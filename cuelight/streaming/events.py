"""The event log as a stream: counts, sessions, votes, forwarding and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cuelight.operators.relational import upsert
from cuelight.sources.tables import EVENT


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Stream of a folder of JSON lines: the envelope and all payload fields, with event_time."""
    return spark.readStream.schema(EVENT).json(path).withColumn("event_time", F.to_timestamp("ts"))


def forwarded(events: DataFrame, queries_too: bool = False) -> DataFrame:
    """Votes, and queries if opted in."""
    kinds = ["feedback", "query"] if queries_too else ["feedback"]
    return events.filter(F.col("type").isin(kinds))


def window_counts(events: DataFrame, time: str, kind: str, size: str, slide: str | None = None, late: str | None = None, value: Column | None = None) -> DataFrame:
    """Events by window and kind; `late` sets a watermark for streams."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    events = events.withWatermark(time, late) if late else events
    out = events.groupBy(F.window(time, size, slide or size).alias("w"), kind).agg(F.count("*").alias("n"), *([F.sum(value).alias("total")] if value is not None else []))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n", *(["total"] if value is not None else []))


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Bursts of a key's events with no pause as long as the gap."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    events = events.withWatermark(time, late) if late else events
    out = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Events without repeats of the same keys within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def vote_tally(events: DataFrame) -> DataFrame:
    """Running votes by chunk: up, down and their difference."""
    votes = events.filter("type = 'feedback'")
    up, down = F.count_if(F.col("vote") == "up"), F.count_if(F.col("vote") == "down")
    return votes.groupBy("chunk_id").agg(up.alias("up"), down.alias("down"), (up - down).alias("net"))


def query_stats(events: DataFrame) -> DataFrame:
    """Queries, empty results, mean and 95th percentile latency."""
    q = events.filter("type = 'query'")
    return q.agg(F.count("*").alias("queries"), F.count_if(F.col("result_count") == 0).alias("empty"), F.avg("latency_ms").alias("mean_latency_ms"), F.percentile_approx("latency_ms", 0.95).alias("p95_latency_ms"))


def to_sink(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append a stream to JSON files, each row once; start() it with a trigger of choice."""
    return events.writeStream.format("json").option("ignoreNullFields", "false").option("path", path).option("checkpointLocation", checkpoint)


def patcher(spark: SparkSession, base_path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch replaces the rows of its keys in a versioned table.

    A batch writes the next version under its own number, so that a repeated batch gives the same version.
    """

    def apply(batch: DataFrame, number: int) -> None:
        base = spark.read.parquet(f"{base_path}/v{number}")
        upsert(base, batch.select(base.columns), keys).write.mode("overwrite").parquet(f"{base_path}/v{number + 1}")

    return apply
