"""Streaming links of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.functions import text as X


def normalize_show_id(show_id: Column, show_title: Column, titles: dict[str, str]) -> Column:
    """The id, stripped in lower case, or the id of a known title."""
    known = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv]) if titles else None
    by_title = F.try_element_at(known, F.lower(X.strip(show_title))) if titles else F.lit(None).cast("string")
    return F.when(F.coalesce(show_id, F.lit("")) != "", F.lower(X.strip(show_id))).otherwise(by_title)


def with_links(results: DataFrame, catalog: DataFrame, default_show: str, titles: dict[str, str], title_url: str, watch_url: str, episodes: DataFrame | None = None) -> DataFrame:
    """results(show_id, show_title, season, episode) with provider, label, url and kind of link.

    catalog(show_id, provider, label, title_id, url) has a row a show. Without a show, and for the default one, the
    link is the default show's; an unknown show gets that too. A provider's own url goes before its title id.
    episodes(show_id, episode_label, video_id) links single episodes where it has them.
    """
    sid = normalize_show_id(F.col("show_id"), F.col("show_title"), titles)
    c = catalog.select(F.col("show_id").alias("_sid"), "provider", "label", F.col("title_id").alias("_title"), F.col("url").alias("_url"))
    rows = results.withColumn("_key", F.coalesce(sid, F.lit(default_show)))
    known = catalog.select(F.col("show_id").alias("_known"))
    rows = rows.join(known, rows["_key"] == known["_known"], "left").withColumn("_key", F.coalesce("_known", F.lit(default_show))).drop("_known")
    rows = rows.join(c, rows["_key"] == c["_sid"], "left").drop("_sid")
    if episodes is not None:
        e = episodes.select(F.col("show_id").alias("_e_show"), F.col("episode_label").alias("_e_label"), F.col("video_id").alias("_video"))
        rows = rows.join(e, (rows["_key"] == e["_e_show"]) & (X.episode_label("season", "episode") == e["_e_label"]), "left").drop("_e_show", "_e_label")
    else:
        rows = rows.withColumn("_video", F.lit(None).cast("string"))
    url = F.coalesce(F.concat(F.lit(watch_url), "_video"), "_url", F.concat(F.lit(title_url), "_title"))
    return rows.withColumns({"stream_provider": F.col("provider"), "stream_label": F.col("label"), "stream_url": url, "stream_link_type": F.when(F.col("_video").isNotNull(), "episode").otherwise("show")}).drop("provider", "label", "_title", "_url", "_video", "_key")
