"""Whole jobs: ingest a folder of subtitles, build and merge indexes, evaluate, patch episodes, take requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelight.functions.scoring import GuardrailConfig
from cuelight.models import Embedder, Reranker
from cuelight.operators import corpus, evaluate, index, relational, search
from cuelight.sources import subtitles, tables


def ingest(spark: SparkSession, root: str, out: str, only_valid: bool = True, width: int = 5, titles: DataFrame | None = None, overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    """Parse all files below root once and write episodes, audit, cues, chunks and manifest below out.

    Gzip and zip wrappers come off first. only_valid leaves out files whose status isn't valid_srt, which
    corpus.skipped(audit) counts. titles(show_id, show_title) names shows.
    """
    subtitles.parse_episodes(subtitles.unwrapped(subtitles.scan_srt(spark, root))).write.mode("overwrite").parquet(f"{out}/episodes")
    episodes = spark.read.parquet(f"{out}/episodes")
    audit = corpus.audit(episodes)
    audit.write.mode("overwrite").parquet(f"{out}/audit")
    audit = spark.read.parquet(f"{out}/audit")
    good = episodes.join(audit.filter("status = 'valid_srt'").select("path"), "path", "left_semi") if only_valid else episodes
    subtitles.cues(good).write.mode("overwrite").parquet(f"{out}/cues")
    cues = spark.read.parquet(f"{out}/cues")
    named = cues if titles is None else cues.join(titles.select("show_id", "show_title"), "show_id", "left")
    corpus.context_chunks(named, width, show_title=None if titles is None else F.col("show_title")).write.mode("overwrite").parquet(f"{out}/chunks")
    chunks = spark.read.parquet(f"{out}/chunks")
    tables.write_csv(corpus.manifest(cues, chunks, audit.select("path", "status"), overrides), f"{out}/manifest")
    return {"episodes": episodes, "audit": audit, "cues": cues, "chunks": chunks, "manifest": tables.read_manifest(spark, f"{out}/manifest")}


def ingest_changed(cues: DataFrame, chunks: DataFrame, new_cues: DataFrame, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Cues and chunks in which the episodes that new_cues has are replaced."""
    keys = ["show_id", "season", "episode"]
    return relational.upsert(cues, new_cues, keys), relational.upsert(chunks, corpus.context_chunks(new_cues, width), keys)


def build(chunks: DataFrame, path: str, model: Embedder, season: int | None = None, least: int | None = None, most: int | None = None, among: list[int] | None = None) -> dict:
    """Index the chunks of the wanted seasons; returns the metadata."""
    return index.save_index(index.build_index(relational.season_filter(chunks, season, least, most, among), model), path, model.name)


def evaluate_queries(queries: DataFrame, chunks: DataFrame, model: Embedder, reranker: Reranker | None = None, config: GuardrailConfig | None = None, season: int | None = None, show: str | None = None) -> dict[str, DataFrame]:
    """Results, ranks, recall, recall by category, misses and negatives of labelled queries."""
    queries = relational.season_or_any(queries, season) if season is not None else queries
    results = search.search(queries.select("query_id", "query"), chunks, model, reranker, config)
    ranks = evaluate.hits(results, queries, show=show)
    negative = queries.filter("category = 'negative'").select("query_id")
    return {"results": results, "ranks": ranks, "recall": evaluate.recall(ranks), "by_category": evaluate.recall(ranks, ["category"]), "misses": evaluate.misses(ranks, results), "negatives": results.join(negative, "query_id", "left_semi")}


def request_log(requests: DataFrame, results: DataFrame, latency_ms: int = 0) -> tuple[DataFrame, DataFrame]:
    """Log rows of valid search requests(query_id, query, top_k), with their first three chunks, and invalid requests."""
    ok = tables.valid_request(F.col("query"), F.col("top_k"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda r: r["chunk_id"])
    found = results.groupBy("query_id").agg(F.count("*").cast("int").alias("result_count"), F.slice(ids, 1, 3).alias("top_chunk_ids"))
    log = requests.filter(ok).join(found, "query_id", "left")
    log = log.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ts"), F.lit("query").alias("type"), "query", "top_k", F.lit(latency_ms).alias("latency_ms"), F.coalesce("result_count", F.lit(0)).alias("result_count"), F.coalesce("top_chunk_ids", F.array().cast("array<string>")).alias("top_chunk_ids"))
    return log, requests.filter(~ok)


def take(results: DataFrame, k: int, per: str = "query_id") -> DataFrame:
    """The first k ranks of each query."""
    by = Window.partitionBy(per).orderBy("rank")
    return results.withColumn("_k", F.row_number().over(by)).filter(F.col("_k") <= k).drop("_k")
