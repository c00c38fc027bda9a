"""SQL surface: functions and views for spark.sql()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.functions import scoring as S
from cuelight.sources import pages

#: SQL bodies that Catalyst inlines; no Python runs for them.
FUNCTIONS = {
    "strip_html": ("x STRING", "STRING", "regexp_replace(x, '<[^>]+>', '')"),
    "clean_cue_text": ("x STRING", "STRING", r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', ''), r'\{\\[^}]+\}', ''), r'\[[^\]]*\]', ' '), r'\([^)]*\)', ' '), '♪+', ' '), r'(?U)^[-–—][\s\x1c-\x1f]*', ''), r'(?U)[\s\x1c-\x1f]+', ' ')))"""),
    "whitespace_tokens": ("x STRING", "ARRAY<STRING>", """regexp_extract_all(lower(coalesce(x, '')), "[a-z0-9']+", 0)"""),
    "cosine": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (acc, x) -> acc + x)"),
    "ms_to_timestamp": ("ms BIGINT", "STRING", "if(greatest(ms, 0) >= 3600000, format_string('%d:%02d:%02d', greatest(ms, 0) div 3600000, greatest(ms, 0) % 3600000 div 60000, greatest(ms, 0) % 60000 div 1000), format_string('%d:%02d', greatest(ms, 0) div 60000, greatest(ms, 0) % 60000 div 1000))"),
    "lexical_mode": ("words ARRAY<STRING>", "STRING", "CASE WHEN size(words) = 0 THEN 'off' WHEN exists(words, t -> t RLIKE '[0-9]') OR size(words) <= 4 THEN 'strict' WHEN size(words) <= 8 THEN 'soft' ELSE 'off' END"),
}


def register(spark: SparkSession) -> None:
    """Make the functions available to SQL in this session."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION walk_graph(document STRING, show_id STRING) RETURNS TABLE(season INT, episode INT, video_id STRING) RETURN SELECT r.season, r.episode, r.video_id FROM (SELECT explode({pages.graph_episodes('walk_graph.document', 'walk_graph.show_id')}) AS r)")
    spark.udf.register("partial_ratio", F.pandas_udf(S._partial_ratio, "double"))
    for name, table in (("episode_links", pages.EpisodeLinks), ("download_boxes", pages.DownloadBoxes)):
        spark.udtf.register(name, table)


def views(tables: dict[str, DataFrame]) -> None:
    """Register tables as views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
