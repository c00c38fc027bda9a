"""Corpus tables and figures: chunks with context, audit, distributions, manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.functions import text as X

#: What keeps the lines of one file together.
FILE = ["show_id", "season", "episode", "source_path"]


def context_chunks(cue_rows: DataFrame, width: int = 5, keys: Sequence[str] = FILE, order: str = "pos", show_title: Column | None = None) -> DataFrame:
    """A chunk per dialogue line: the line, the lines around it and its ids by place among dialogue lines.

    Frames end at the ends of a file. One shuffle by file serves place and context alike.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    near = lambda a, b: F.collect_list("text_clean").over(by.rowsBetween(a, b))
    rows = cue_rows.filter(X.dialogue("is_watermark", "text_clean")).withColumns({
        "_pos": F.row_number().over(by) - 1, "context_before": near(-width, -1), "context_after": near(1, width), "text_embed": F.array_join(near(-width, width), "\n"),
    })
    return rows.select(
        X.chunk_id("show_id", "season", "episode", "_pos").alias("chunk_id"), "show_id", (F.lit(None).cast("string") if show_title is None else show_title).alias("show_title"), "season", "episode", F.col("_pos").alias("cue_index"),
        "start_ms", "end_ms", "speaker", F.col("text_raw").alias("text_line"), "text_clean", "text_embed", "context_before", "context_after",
        X.n_tokens("text_clean").alias("token_count_line"), X.n_tokens("text_embed").alias("token_count_embed"),
    )


def frame_tokens(lines: DataFrame, widths: Sequence[int], keys: Sequence[str], order: str, count: Column) -> DataFrame:
    """(width, tokens) of each line's window. Tokens don't run over line ends, so that a window has its lines' sum."""
    by = Window.partitionBy(*keys).orderBy(order)
    rows = lines.withColumn("_n", count)
    sums = [F.struct(F.lit(w).alias("width"), F.sum("_n").over(by.rowsBetween(-w, w)).alias("tokens")) for w in widths]
    return rows.select(F.array(*sums).alias("_w")).select(F.inline("_w"))


def distribution(df: DataFrame, value: str, keys: Sequence[str] = (), ranks: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """count, mean, stdev (of the population), min, max and percentiles of integers by key.

    The p-th percentile is the value at place floor(p * n) of the sorted ones, the last at most. Places come from
    the running sum of counts of distinct values, so that no task holds all values; a key's distinct values meet in
    one task. Without keys, no rows give a row of zeros.
    """
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    by = Window.partitionBy(*keys)
    upto = F.sum("_k").over(by.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"_upto": upto, "_n": F.sum("_k").over(by)})
    at = lambda p: F.min(F.when(F.col("_upto") > F.least(F.floor(F.lit(p) * F.col("_n")), F.col("_n") - 1), F.col("_v")))
    total, square = F.sum(F.col("_v") * F.col("_k")), F.sum(F.col("_v") * F.col("_v") * F.col("_k"))
    n = F.max("_n")
    mean = total / n
    out = placed.groupBy(*keys).agg(n.alias("count"), F.round(mean, 2).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), square / n - mean * mean)), 2).alias("stdev"), F.min("_v").alias("min"), *[at(p).alias(f"p{round(p * 100)}") for p in ranks], F.max("_v").alias("max"))
    return out if keys else out.fillna(0)


def skipped(audit: DataFrame, keep: str = "valid_srt") -> DataFrame:
    """(total, skipped): files, and those whose status leaves them out."""
    return audit.agg(F.count("*").alias("total"), F.count_if(~F.col("status").eqNullSafe(F.lit(keep))).alias("skipped"))


def pct_over(value: Column, limit: int) -> Column:
    """Aggregate: per cent of values over the limit, with two decimals; 0 for none."""
    return F.coalesce(F.round(100.0 * F.count_if(value > limit) / F.count("*"), 2), F.lit(0.0))


def top_duplicates(lines: DataFrame, value: str, order: Sequence[str], n: int = 20) -> DataFrame:
    """The n commonest values that occur twice or more; of equals the one that comes first."""
    counts = lines.filter(F.col(value) != "").groupBy(value).agg(F.count("*").alias("count"), F.min(F.struct(*order)).alias("_first"))
    return counts.filter("count >= 2").orderBy(F.desc("count"), "_first").limit(n).select(value, "count")


def corpus_summary(chunks: DataFrame, by_show: bool = False) -> DataFrame:
    """Chunks, episodes (of one numbering, or by show), lines with a speaker, and the share of lines below 4 tokens."""
    key = F.struct("show_id", "season", "episode") if by_show else F.struct("season", "episode")
    share = lambda c: F.coalesce(F.round(100.0 * F.count_if(c) / F.count("*"), 2), F.lit(0.0))
    named = F.coalesce(F.col("speaker") != "", F.lit(False))
    return chunks.agg(F.count("*").alias("chunk_count"), F.count_distinct(F.when(F.col("season").isNotNull(), key)).alias("episode_count"), F.count_if(named).alias("speaker_attributed_cues"), share(named).alias("speaker_attributed_pct"), share(F.col("token_count_line") < 4).alias("short_line_lt4_tokens_pct"))


def corpus_report(chunks: DataFrame, widths: Sequence[int] = (3, 5, 7), limits: Sequence[int] = (256, 384), keys: Sequence[str] = FILE[:3]) -> DataFrame:
    """One nested row: summary, distributions, ablation of context widths, truncation and duplicate lines."""
    whole = lambda df, name: df.select(F.struct("*").alias(name))
    windows = frame_tokens(chunks, widths, keys, "cue_index", F.col("token_count_line"))
    cut = windows.groupBy("width").agg(*[pct_over(F.col("tokens"), x).alias(f"pct_truncated_at_{x}") for x in limits])
    ablation = distribution(windows, "tokens", ["width"]).join(cut, "width").agg(F.map_from_entries(F.collect_list(F.struct(F.col("width").cast("string"), F.struct("*")))).alias("context_ablation"))
    out = whole(corpus_summary(chunks), "summary")
    out = out.join(whole(distribution(chunks, "token_count_line"), "cue_line_tokens"), how="left").join(whole(distribution(chunks, "token_count_embed"), "chunk_embed_tokens"), how="left").join(ablation)
    truncated = chunks.agg(F.struct(*[pct_over(F.col("token_count_embed"), x).alias(f"at_{x}") for x in limits]).alias("model_truncation"))
    lines = top_duplicates(chunks, "text_clean", ["show_id", "season", "episode", "cue_index"]).agg(F.sort_array(F.collect_list(F.struct("count", "text_clean")), False).alias("top_duplicate_lines"))
    return out.join(truncated).join(lines)


def audit(episodes: DataFrame) -> DataFrame:
    """A row per parsed file: status, counts, duration of its dialogue and the first three errors."""
    spoken = F.filter("cues", lambda c: ~c["is_watermark"] & (c["text_clean"] != ""))
    ends, starts = F.transform(spoken, lambda c: c["end_ms"]), F.transform(spoken, lambda c: c["start_ms"])
    status = X.file_status(F.col("length"), F.col("is_html"), F.size(spoken))
    return episodes.select(
        "path", "season", "episode", "release_group", status.alias("status"), F.col("length").alias("file_size_bytes"), F.size("cues").alias("cue_count"), F.size(spoken).alias("dialogue_cue_count"),
        (F.array_max(ends) - F.array_min(starts)).alias("duration_ms"), F.exists("cues", lambda c: c["is_watermark"]).alias("has_watermark"), F.size("parse_errors").alias("parse_error_count"),
        F.when(F.col("is_html") & (F.col("length") > 0), "File looks like an HTML page, not subtitles.").otherwise(F.array_join(F.slice("parse_errors", 1, 3), "; ")).alias("error_message"),
    )


def status_counts(files: DataFrame, status: Column | str = "status", known: Sequence[str] = (), other: str = "failed") -> DataFrame:
    """Files by status; with `known`, any other status counts as `other`."""
    status = F.col(status) if isinstance(status, str) else status
    return files.groupBy((F.when(status.isin(*known), status).otherwise(other) if known else status).alias("status")).count()


def manifest(cue_rows: DataFrame, chunks: DataFrame, files: DataFrame, overrides: DataFrame | None = None, pos: Sequence[str] = ("source_path", "pos")) -> DataFrame:
    """A row per (show, season, episode): counts, and path, release and language of the first cue.

    overrides(show_id, season, episode, language) names episodes known to be translated; a null show_id there holds
    for every show.
    """
    key = ["show_id", "season", "episode"]
    order = F.struct(*pos)
    first = lambda c: F.min_by(c, order).alias(c)
    rows = cue_rows.groupBy(*key).agg(first("source_path"), first("release_group"), first("detected_language"), first("was_translated"), F.count("*").alias("cue_count"), F.count_if(X.dialogue("is_watermark", "text_clean")).alias("dialogue_cue_count"))
    counts = chunks.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.count("*").alias("chunk_count"))
    rows = rows.join(counts, [rows[k].eqNullSafe(counts[f"_{k}"]) for k in key], "left").join(files.select(F.col("path").alias("source_path"), F.col("status").alias("audit_status")), "source_path", "left")
    language = F.coalesce("detected_language", F.lit(""))
    done = F.coalesce("was_translated", F.lit(False))
    if overrides is not None:
        o = overrides.select(F.col("show_id").alias("_o_show"), F.col("season").alias("_o_season"), F.col("episode").alias("_o_episode"), "language")
        rows = rows.join(o, (rows["season"] == o["_o_season"]) & (rows["episode"] == o["_o_episode"]) & (o["_o_show"].isNull() | (rows["show_id"] == o["_o_show"])), "left")
        language, done = F.coalesce("language", language), F.col("language").isNotNull() | done
    return rows.select(
        "show_id", "season", "episode", F.when(F.col("season").isNotNull() & F.col("episode").isNotNull(), F.concat_ws("_", "show_id", X.episode_label("season", "episode"))).alias("episode_id"), "release_group", F.col("source_path").alias("subtitle_path"),
        "audit_status", language.alias("detected_language"), F.initcap(done.cast("string")).alias("was_translated"), "cue_count", "dialogue_cue_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), (F.col("audit_status") == "valid_srt").alias("verified"),
    ).orderBy(F.coalesce("season", F.lit(0)), F.coalesce("episode", F.lit(0)), "show_id")


def group_counts(df: DataFrame, *keys: Column | str, fallback: str = "unknown") -> DataFrame:
    """Rows by the first key that isn't null or empty, commonest first."""
    filled = [F.nullif(F.col(k) if isinstance(k, str) else k, F.lit("")) for k in keys]
    return df.groupBy(F.coalesce(*filled, F.lit(fallback)).alias("key")).count().orderBy(F.desc("count"), "key")


def catalog_summary(shows: DataFrame) -> DataFrame:
    """Shows, episodes in all, and the shows as a list."""
    return shows.agg(F.count("*").alias("shows"), F.sum("episodes_total").alias("episodes"), F.sort_array(F.collect_list(F.struct("show_id", "show_title", "seasons", "episodes_total"))).alias("list"))


def pipeline_estimate(sample: DataFrame, episodes_target: int, seconds_per_chunk: float = 0.0033, speedup: float = 25.0, dim: int = 384, row_bytes: int = 450) -> DataFrame:
    """Extrapolation from sampled files(chunks, parse_seconds) to a catalog: times and index size."""
    per = sample.agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.avg("chunks").alias("chunks_per_file"), F.avg("parse_seconds").alias("parse_seconds_per_file"))
    n = F.floor(F.lit(episodes_target) * F.col("chunks_per_file"))
    cpu = n * F.lit(seconds_per_chunk)
    return per.select("*", n.alias("estimated_chunks"), X.format_seconds(F.col("parse_seconds_per_file") * episodes_target).alias("parse_total"), X.format_seconds(cpu).alias("embed_total_cpu"), X.format_seconds(cpu / speedup).alias("embed_total_gpu"), F.round(n * dim * 4 / 1e6, 1).alias("vectors_mb"), F.round(n * row_bytes / 1e6, 1).alias("rows_mb"), F.round(n * (dim * 4 + row_bytes) / 1e6, 1).alias("index_mb"))
