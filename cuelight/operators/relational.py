"""Relational shapes that several jobs share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order; the planner cuts groups before and after the shuffle."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(by)).filter(F.col("_place") <= n).drop("_place")


def best_subtitle(items: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Of items(format, hearing_impaired, download_count): srt before sub before others, then plain ones, then downloads, then first."""
    kind = F.lower(F.coalesce("format", F.lit("")))
    rank = F.when(kind == "srt", 2).when(kind == "sub", 1).otherwise(0)
    return first_per_key(items, keys, [rank.desc(), F.coalesce("hearing_impaired", F.lit(False)), F.coalesce("download_count", F.lit(0)).desc(), pos])


def upsert(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base without the keys that patch has, and patch; null keys match null keys."""
    gone = patch.select([F.col(k).alias(f"_{k}") for k in keys]).distinct()
    kept = base.join(gone, [base[k].eqNullSafe(gone[f"_{k}"]) for k in keys], "left_anti")
    return kept.unionByName(patch, allowMissingColumns=True)


def season_filter(df: DataFrame, season: int | None = None, least: int | None = None, most: int | None = None, among: Sequence[int] | None = None) -> DataFrame:
    """Rows of the wanted seasons; a null season passes none of the tests."""
    s = F.col("season")
    for ok, test in ((season, s == season), (least, s >= least if least is not None else None), (most, s <= most if most is not None else None), (among, s.isin(list(among or [])))):
        if ok is not None:
            df = df.filter(test)
    return df


def season_or_any(df: DataFrame, season: int, column: str = "expected_season") -> DataFrame:
    """Queries of a season, and those of none."""
    return df.filter(F.col(column).isNull() | (F.col(column) == season))


def show_filter(df: DataFrame, shows: Sequence[str] | None, column: str = "show_id") -> DataFrame:
    """Rows of the named shows; all rows if none is named."""
    return df.filter(F.col(column).isin(list(shows))) if shows else df


def sorted_seasons(df: DataFrame) -> DataFrame:
    """(season): the distinct seasons in order, without null."""
    return df.filter("season IS NOT NULL").select("season").distinct().orderBy("season")


def in_order(df: DataFrame, position: str = "cue_index") -> DataFrame:
    """Cues or chunks by show, season, episode and position, missing seasons and episodes as 0; ranges of rows sort apart."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.orderBy("show_id", zero("season"), zero("episode"), position)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, count) of keys that are there more than once."""
    return df.groupBy(key).count().filter("count > 1")


def not_downloaded(wanted: DataFrame, listing: DataFrame, key: str, least_bytes: int = 50) -> DataFrame:
    """Wanted rows without a file of more than so many bytes."""
    return wanted.join(listing.filter(F.col("length") > least_bytes), key, "left_anti")


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """df, if no key is there twice; raises with some that are."""
    twice = repeated_keys(df, key).limit(5).collect()
    if twice:
        raise ValueError(f"{key} is not unique: {[r[key] for r in twice]}")
    return df


def metadata_filter(df: DataFrame, year_min: int | None = None, year_max: int | None = None, genre: str | None = None, director: str | None = None) -> DataFrame:
    """Rows of films(year, genres, director) within the given limits."""
    if year_min is not None:
        df = df.filter(F.col("year") >= year_min)
    if year_max is not None:
        df = df.filter(F.col("year") <= year_max)
    if genre is not None:
        df = df.filter(F.array_contains("genres", genre))
    return df.filter(F.lower("director") == director.lower()) if director is not None else df
