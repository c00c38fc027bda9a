"""Text functions of dialogue lines: column to column, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode and the control separators have it.
WS = r"(?U)[\s\x1c-\x1f]"

# Marks of lines that a subtitle site adds, of HTML pages in place of files, and stop words.
WATERMARKS = ("my-subs.com", "translated by the community", "www.my-subs")
STOPWORDS = (
    "a an the and or but if then else when at by with for about against between into through during before after above below to from "
    "up down in out on off over under again further once here there all each few more most other some such no nor not only own same "
    "so than too very can will just don should now is are was were be been being have has had do does did doing what which who wh "
    "this that these those am i you he she it we they me him her us them my your his its our their of as"
).split()
HTML_MARKERS = ("<!doctype html", "<html", "<head>")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip_html(x: Column | str) -> Column:
    """Without tags."""
    return F.regexp_replace(_c(x), "<[^>]+>", "")


def clean_cue_text(x: Column | str, for_embed: bool = True) -> Column:
    """Line for search (lower case, no stage directions or notes) or, without for_embed, for display."""
    x = F.regexp_replace(strip_html(x), r"\{\\[^}]+\}", "")
    if for_embed:
        for pattern in (r"\[[^\]]*\]", r"\([^)]*\)", "♪+"):
            x = F.regexp_replace(x, pattern, " ")
    x = F.regexp_replace(x, r"(?U)^[-–—][\s\x1c-\x1f]*", "")
    x = F.trim(F.regexp_replace(x, WS + "+", " "))
    return F.lower(x) if for_embed else x


def title_case(x: Column) -> Column:
    """Upper case for each letter that follows none, lower case for the others (ASCII)."""
    chars = F.split(F.lower(x), "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((i == 0) | ~F.coalesce(F.get(chars, i - 1), F.lit("")).rlike("[a-z]"), F.upper(c)).otherwise(c)), "")


_SPEAKER = r"(?d)^(?:[-–—]\s*)?([A-Z][A-Z0-9 .'-]{0,30})\s*:\s*(.+)$"


def speaker(x: Column | str) -> Column:
    """struct(speaker, body): the upper-case name before a colon, of four words at most; else null and the line."""
    x = _c(x)
    line = strip(x)
    name = F.trim(F.regexp_extract(line, _SPEAKER, 1))
    found = line.rlike(_SPEAKER) & (F.size(F.split(name, " +")) <= 4)
    return F.struct(F.when(found, title_case(name)).alias("speaker"), F.when(found, strip(F.regexp_extract(line, _SPEAKER, 2))).otherwise(x).alias("body"))


def is_watermark(x: Column | str) -> Column:
    """Does the line hold a mark of a subtitle site?"""
    low, out = F.lower(_c(x)), F.lit(False)
    for mark in WATERMARKS:
        out = out | low.contains(mark)
    return out


def tokens(x: Column | str) -> Column:
    """Runs of a-z, 0-9 and apostrophes in lower case; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))


def n_tokens(x: Column | str) -> Column:
    """Number of tokens()."""
    return F.regexp_count(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("[a-z0-9']+"))


def dialogue(watermark: Column | str, clean: Column | str) -> Column:
    """Predicate of lines that count as dialogue."""
    return ~_c(watermark) & (_c(clean) != "")


def html_wrapper(content: Column | str) -> Column:
    """Is a file's head, its first 256 bytes, that of an HTML page?"""
    head = F.lower(F.decode(F.substring(_c(content), 1, 256), "ISO-8859-1"))
    out = F.lit(False)
    for mark in HTML_MARKERS:
        out = out | head.contains(mark)
    return out


def file_status(size: Column, html: Column, n_dialogue: Column, least: int = 50, undecodable: Column | None = None) -> Column:
    """First of empty, html_wrapper, encoding_error, no_dialogue_cues and low_cue_count that holds, else valid_srt.

    decode_text() reads any bytes, so that `undecodable` is for callers with a stricter reader or a wrapper without text.
    """
    broken = F.lit(False) if undecodable is None else F.coalesce(undecodable, F.lit(False))
    return F.when(size == 0, "empty").when(html, "html_wrapper").when(broken, "encoding_error").when(n_dialogue == 0, "no_dialogue_cues").when(n_dialogue < least, "low_cue_count").otherwise("valid_srt")


def decode_text(content: Column | str) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1; a byte order mark goes."""
    content = _c(content)
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


TIMESTAMP = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{3})"
TIMESTAMP_LINE = rf"^{TIMESTAMP}\s*-->\s*{TIMESTAMP}"


def timestamp_ms(x: Column | str, pattern: str = rf"^\s*{TIMESTAMP}", first: int = 1) -> Column:
    """H:MM:SS,mmm as milliseconds; null where the text is none."""
    part = lambda k: F.regexp_extract(_c(x), pattern, first + k).try_cast("long")
    return part(0) * 3_600_000 + part(1) * 60_000 + part(2) * 1000 + part(3)


def format_ms(ms: Column | str) -> Column:
    """H:MM:SS.mmm."""
    ms = _c(ms).cast("long")
    return F.format_string("%d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), F.floor(ms % 60_000 / 1000), ms % 1000)


def ms_to_timestamp(ms: Column | str) -> Column:
    """H:MM:SS, or M:SS below an hour; negative times count as 0."""
    s = F.floor(F.greatest(_c(ms).cast("long"), F.lit(0)) / 1000)
    h, m, s = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def episode_label(season: Column | str, episode: Column | str) -> Column:
    """SxxEyy, null if either number is."""
    season, episode = _c(season), _c(episode)
    return F.when(season.isNotNull() & episode.isNotNull(), F.format_string("S%02dE%02d", season.cast("int"), episode.cast("int")))


def cue_id(show: Column | str, season: Column | str, episode: Column | str, pos: Column | str) -> Column:
    """show_SxxEyy_nnnnn, or show_nnnnn if either number is null."""
    return F.concat_ws("_", _c(show), episode_label(season, episode), F.format_string("%05d", _c(pos).cast("int")))


def chunk_id(show: Column | str, season: Column | str, episode: Column | str, pos: Column | str) -> Column:
    """As cue_id(), but season 0 and episode 0 count as missing too."""
    real = (F.coalesce(_c(season), F.lit(0)) != 0) & (F.coalesce(_c(episode), F.lit(0)) != 0)
    return F.concat_ws("_", _c(show), F.when(real, episode_label(season, episode)), F.format_string("%05d", _c(pos).cast("int")))


_NAMED, _FLAT = r"(?i)\.S(\d+)E(\d+)\.([^/\\]+)\.srt$", r"(?i)^S(\d+)E(\d+)\.srt$"


def episode_of_path(path: Column | str) -> Column:
    """struct(season, episode, release_group) that a file's name tells; nulls where it tells none."""
    name = F.regexp_extract(_c(path), r"([^/\\]*)$", 1)
    named = name.rlike(_NAMED)
    number = lambda k: F.coalesce(F.when(named, F.regexp_extract(name, _NAMED, k)), F.regexp_extract(name, _FLAT, k)).try_cast("int")
    return F.struct(number(1).alias("season"), number(2).alias("episode"), F.when(named, F.regexp_extract(name, _NAMED, 3)).alias("release_group"))


def normalize_key(x: Column | str) -> Column:
    """Stripped, in lower case, with single blanks."""
    return F.regexp_replace(F.lower(strip(_c(x))), WS + "+", " ")


def safe_name(x: Column | str) -> Column:
    """Name of letters, digits, dots, dashes and underscores."""
    return F.regexp_replace(F.regexp_replace(_c(x), "[^a-zA-Z0-9._-]+", "_"), "^_+|_+$", "")


def format_seconds(s: Column | str) -> Column:
    """Seconds, minutes or hours with one decimal."""
    s = _c(s).cast("double")
    return F.when(s < 60, F.format_string("%.1fs", s)).when(s < 3600, F.format_string("%.1fm", s / 60)).otherwise(F.format_string("%.1fh", s / 3600))


def distinctive_tokens(query: Column | str) -> Column:
    """Tokens of a cleaned query that aren't stop words and have three letters or a digit; repeats stay."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(tokens(clean_cue_text(query)), lambda t: ~F.array_contains(stop, t) & ((F.length(t) >= 3) | t.rlike("[0-9]")))


def lexical_mode(words: Column | str) -> Column:
    """strict, soft or off, by a query's distinctive tokens."""
    words = _c(words)
    n = F.size(words)
    return F.when(n == 0, "off").when(F.exists(words, lambda t: t.rlike("[0-9]")) | (n <= 4), "strict").when(n <= 8, "soft").otherwise("off")


def token_hits(words: Column | str, line: Column | str) -> Column:
    """How many of the tokens, repeats included, are substrings of a cleaned line."""
    line = _c(line)
    return F.size(F.filter(_c(words), lambda t: F.contains(line, t)))
