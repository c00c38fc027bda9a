"""Registered queries of the dialogue engine on the standard tables, each beside the SQL that must agree.

Stand-ins: a conversation is an episode (season conv_id / 10, episode conv_id), its turns are cues; documents are
subtitle bodies of a show (source); embeddings are index vectors whose label is the episode.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.functions import scoring as S
from cuelight.functions import text as X
from cuelight.models import HashedEmbedder, OverlapReranker, modest_batches
from cuelight.operators import corpus, evaluate, index, links, relational, search
from cuelight.sources import pages, subtitles, tables
from cuelight.streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _shared(spark: SparkSession, name: str) -> str:
    """A fresh folder where the session keeps what all machines share; a temporary one in local mode without such."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="cuelight-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what is read several times."""
    path = _shared(df.sparkSession, name)
    modest_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cue_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations in the shape of cues."""
    null = F.lit(None).cast("string")
    rows = table(spark, sf, "conversations").select(
        F.lit("talk").alias("show_id"), F.floor(F.col("conv_id") / 10).cast("int").alias("season"), F.col("conv_id").cast("int").alias("episode"), null.alias("release_group"), F.concat(F.lit("c"), "conv_id").alias("source_path"),
        F.col("turn").cast("int").alias("pos"), (F.col("turn") * 2000).alias("start_ms"), (F.col("turn") * 2000 + 1500).alias("end_ms"), F.col("role").alias("speaker"), F.col("text").alias("text_raw"),
    )
    return rows.withColumns({"text_clean": X.clean_cue_text("text_raw"), "is_watermark": X.is_watermark("text_raw"), "detected_language": null, "was_translated": F.lit(False)})


def line_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents: doc_id, source, line_no (from 0), line."""
    return table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.context_chunks(cue_rows(spark, sf), show_title=F.lit("Talk"))


def _clean(x: str, lower: bool = True) -> str:
    x = f"regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '\\{{\\\\[^}}]+\\}}', '', 'g')"
    if lower:
        for p in (r"\[[^\]]*\]", r"\([^)]*\)", "♪+"):
            x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    x = f"trim(regexp_replace(regexp_replace({x}, '^[-–—]\\s*', ''), '\\s+', ' ', 'g'))"
    return f"lower({x})" if lower else x


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9'']+')"


_MARK = " OR ".join(f"contains(lower({{0}}), '{m}')" for m in X.WATERMARKS)
_CUES = f"""cues AS (SELECT 'talk' AS show_id, CAST(floor(conv_id / 10) AS INT) AS season, CAST(conv_id AS INT) AS episode, CAST(turn AS INT) AS pos, turn * 2000 AS start_ms, turn * 2000 + 1500 AS end_ms,
 role AS speaker, text AS text_raw, {_clean("text")} AS text_clean, {_MARK.format("text")} AS is_watermark FROM conversations)"""
_DIALOGUE = f"""{_CUES}, said AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY pos) - 1 AS p, len({_tokens("text_clean")}) AS n FROM cues WHERE NOT is_watermark AND text_clean <> '')"""


# Text functions


@query(f"SELECT doc_id, {_clean('text')} AS text_clean FROM documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned text for search."""
    return table(spark, sf, "documents").select("doc_id", X.clean_cue_text("text").alias("text_clean"))


@query(f"SELECT page_id, {_clean('html', False)} AS text_display FROM pages")
def clean_text_display(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned text for display, of pages that have tags."""
    return table(spark, sf, "pages").select("page_id", X.clean_cue_text("html", for_embed=False).alias("text_display"))


@query(f"SELECT doc_id, CAST(len({_tokens('text')}) AS INT) AS n_tokens FROM documents")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each document."""
    return table(spark, sf, "documents").select("doc_id", X.n_tokens("text").cast("int").alias("n_tokens"))


_LINES = "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@query(f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, {_MARK.format('line')} AS is_watermark FROM lines WHERE {_MARK.format('line')} OR contains(lower(line), 'licensed')")
def watermark_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a site's mark, or a licence for lack of such."""
    lines = line_rows(spark, sf).withColumn("is_watermark", X.is_watermark("line"))
    return lines.filter(F.col("is_watermark") | F.lower("line").contains("licensed")).select("doc_id", "line_no", "is_watermark")


@query(f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, {_clean('line')} AS text_clean FROM lines WHERE NOT ({_MARK.format('line')}) AND {_clean('line')} <> ''")
def dialogue_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that count as dialogue."""
    lines = line_rows(spark, sf).withColumns({"text_clean": X.clean_cue_text("line"), "is_watermark": X.is_watermark("line")})
    return lines.filter(X.dialogue("is_watermark", "text_clean")).select("doc_id", "line_no", "text_clean")


@query("""WITH t AS (SELECT conv_id, turn, string_split(upper(role) || ': ' || text, chr(10)) AS ls FROM conversations), l AS (SELECT conv_id, turn, unnest(range(len(ls))) AS k, ls FROM t),
x AS (SELECT conv_id, turn, CAST(k AS INT) AS line_no, ls[k + 1] AS line FROM l)
SELECT conv_id, turn, line_no, CASE WHEN m THEN upper(substr(name, 1, 1)) || lower(substr(name, 2)) END AS speaker, CASE WHEN m THEN trim(body) ELSE line END AS body
FROM (SELECT *, regexp_matches(trim(line), '^[A-Z][A-Z0-9 .''-]{0,30}\\s*:\\s*.+$') AS m, regexp_extract(trim(line), '^([A-Z]+)\\s*:', 1) AS name, regexp_extract(trim(line), '^[A-Z]+\\s*:\\s*(.+)$', 1) AS body FROM x)""")
def speaker_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Speaker and words of every line of every turn, whose first line begins with the role; line_no from 0."""
    text = F.concat(F.upper("role"), F.lit(": "), "text")
    lines = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.withColumn("s", X.speaker("line")).select("conv_id", "turn", "line_no", "s.speaker", "s.body")


_DAY_MS = "(epoch_us(ts) % 86400000000) // 1000"


@query(f"""WITH e AS (SELECT event_id, {_DAY_MS} AS ms FROM events) SELECT event_id, printf('%d:%02d:%02d.%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS long,
CASE WHEN ms >= 3600000 THEN printf('%d:%02d:%02d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000) ELSE printf('%d:%02d', ms // 60000, ms % 60000 // 1000) END AS short FROM e""")
def timestamp_format(spark: SparkSession, sf: str) -> DataFrame:
    """Time of day in both display forms."""
    return _times(spark, sf).select("event_id", X.format_ms("ms").alias("long"), X.ms_to_timestamp("ms").alias("short"))


def _times(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.floor(micros % 86_400_000_000 / 1000).alias("ms"))


@query(f"SELECT event_id, {_DAY_MS} AS ms FROM events")
def timestamp_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Milliseconds read back from a subtitle's time."""
    written = F.regexp_replace(X.format_ms("ms"), r"\.", ",")
    return _times(spark, sf).select("event_id", X.timestamp_ms(written).alias("ms"))


@query("""WITH f AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 = 0 THEN printf('/a/S%02dE%02d.srt', conv_id // 10, conv_id) WHEN conv_id % 3 = 1 THEN printf('/a/Show.Name.S%02dE%02d.HDTV.srt', conv_id // 10, conv_id) ELSE printf('/a/Show.S%02dE%02d.srt', conv_id // 10, conv_id) END AS path FROM conversations)
SELECT path, CASE WHEN conv_id % 3 < 2 THEN CAST(conv_id // 10 AS INT) END AS season, CASE WHEN conv_id % 3 < 2 THEN CAST(conv_id AS INT) END AS episode, CASE WHEN conv_id % 3 = 1 THEN 'HDTV' END AS release_group,
CASE WHEN conv_id % 3 < 2 THEN printf('S%02dE%02d', conv_id // 10, conv_id) END AS label FROM f""")
def episode_label(spark: SparkSession, sf: str) -> DataFrame:
    """Season, episode and release group from file names."""
    c, s, e = F.col("conv_id"), F.floor(F.col("conv_id") / 10).cast("int"), F.col("conv_id").cast("int")
    path = F.when(c % 3 == 0, F.format_string("/a/S%02dE%02d.srt", s, e)).when(c % 3 == 1, F.format_string("/a/Show.Name.S%02dE%02d.HDTV.srt", s, e)).otherwise(F.format_string("/a/Show.S%02dE%02d.srt", s, e))
    rows = table(spark, sf, "conversations").select("conv_id").distinct().select(path.alias("path")).select("path", X.episode_of_path("path").alias("x"))
    return rows.select("path", "x.*", X.episode_label("x.season", "x.episode").alias("label"))


@query("""WITH f AS (SELECT 'p' || page_id AS path, html AS body FROM pages UNION ALL SELECT 'd' || doc_id, text FROM documents),
g AS (SELECT path, body, len(list_filter(string_split(body, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS n, lower(substr(body, 1, 256)) AS head FROM f)
SELECT status, count(*) AS count FROM (SELECT CASE WHEN body = '' THEN 'empty' WHEN contains(head, '<!doctype html') OR contains(head, '<html') OR contains(head, '<head>') THEN 'html_wrapper' WHEN n = 0 THEN 'no_dialogue_cues' WHEN n < 5 THEN 'low_cue_count' ELSE 'valid_srt' END AS status FROM g) GROUP BY 1""")
def file_status(spark: SparkSession, sf: str) -> DataFrame:
    """Files, pages among them, by status; lines stand for cues."""
    files = table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("path"), F.col("html").alias("body")).unionByName(table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("body")))
    n = F.size(F.filter(F.split("body", "\n"), lambda x: F.regexp_replace(x, "[ \t\r]", "") != ""))
    return corpus.status_counts(files, X.file_status(F.octet_length("body"), X.html_wrapper(F.col("body").cast("binary")), n, 5))


# Chunks and figures


@query(f"""WITH {_DIALOGUE} SELECT show_id || '_' || CASE WHEN season <> 0 AND episode <> 0 THEN printf('S%02dE%02d', season, episode) || '_' ELSE '' END || printf('%05d', p) AS chunk_id, CAST(p AS INT) AS cue_index, text_clean,
coalesce(string_agg(text_clean, ' / ' ORDER BY pos) OVER (PARTITION BY episode ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS context_before,
coalesce(string_agg(text_clean, ' / ' ORDER BY pos) OVER (PARTITION BY episode ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), '') AS context_after,
string_agg(text_clean, chr(10) ORDER BY pos) OVER (PARTITION BY episode ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS text_embed,
CAST(n AS INT) AS token_count_line, CAST(sum(n) OVER (PARTITION BY episode ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS INT) AS token_count_embed FROM said""")
def context_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with five lines of context on either side."""
    c = chunk_rows(spark, sf)
    return c.select("chunk_id", "cue_index", "text_clean", F.array_join("context_before", " / ").alias("context_before"), F.array_join("context_after", " / ").alias("context_after"), "text_embed", F.col("token_count_line").cast("int").alias("token_count_line"), F.col("token_count_embed").cast("int").alias("token_count_embed"))


def _figures(source: str, key: str) -> str:
    at = lambda p: f"CAST(v[least(len(v), CAST(floor({p}::DOUBLE * len(v)) AS BIGINT) + 1)] AS BIGINT)"
    return f"""SELECT {key} AS k, len(v) AS count, round(list_avg(v), 2) AS mean, round(list_stddev_pop(v), 2) AS stdev, CAST(v[1] AS BIGINT) AS min, {at(0.5)} AS p50, {at(0.9)} AS p90, {at(0.95)} AS p95, {at(0.99)} AS p99, CAST(v[-1] AS BIGINT) AS max
FROM (SELECT {key}, list_sort(list(x)) AS v FROM {source} GROUP BY {key})"""


def _figure_columns(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), "count", "mean", "stdev", *[F.col(c).cast("long").alias(c) for c in ("min", "p50", "p90", "p95", "p99", "max")])


@query(f"WITH t AS (SELECT source AS k0, len({_tokens('text')}) AS x FROM documents) " + _figures("t", "k0").replace("list_stddev_pop(v)", "sqrt(greatest(0, list_avg(list_transform(v, lambda y: y::DOUBLE * y)) - list_avg(v) * list_avg(v)))"))
def token_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Distribution of tokens by source."""
    rows = table(spark, sf, "documents").select("source", X.n_tokens("text").cast("long").alias("x"))
    return _figure_columns(corpus.distribution(rows, "x", ["source"]), "source")


_WINDOWS = " UNION ALL ".join(f"SELECT {w} AS width, CAST(sum(n) OVER (PARTITION BY episode ORDER BY pos ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING) AS BIGINT) AS x FROM said" for w in (3, 5, 7))


@query(f"""WITH {_DIALOGUE}, w AS ({_WINDOWS}), f AS ({_figures("w", "width").replace("list_stddev_pop(v)", "sqrt(greatest(0, list_avg(list_transform(v, lambda y: y::DOUBLE * y)) - list_avg(v) * list_avg(v)))")})
SELECT f.*, pct_256, pct_384 FROM f JOIN (SELECT width, round(100.0 * count(*) FILTER (WHERE x > 256) / count(*), 2) AS pct_256, round(100.0 * count(*) FILTER (WHERE x > 384) / count(*), 2) AS pct_384 FROM w GROUP BY width) c ON f.k = c.width""")
def context_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of windows of 3, 5 and 7 lines, and how many exceed a model's limit."""
    c = chunk_rows(spark, sf)
    w = corpus.frame_tokens(c, (3, 5, 7), corpus.FILE[:3], "cue_index", F.col("token_count_line").cast("long"))
    cut = w.groupBy("width").agg(corpus.pct_over(F.col("tokens"), 256).alias("pct_256"), corpus.pct_over(F.col("tokens"), 384).alias("pct_384"))
    return _figure_columns(corpus.distribution(w, "tokens", ["width"]), "width").join(cut.withColumnRenamed("width", "k"), "k")


@query(f"""WITH {_DIALOGUE} SELECT count(*) AS chunk_count, count(DISTINCT (season, episode)) AS episode_count, count(*) FILTER (WHERE speaker <> '') AS speaker_attributed_cues, round(100.0 * count(*) FILTER (WHERE speaker <> '') / count(*), 2) AS speaker_attributed_pct, round(100.0 * count(*) FILTER (WHERE n < 4) / count(*), 2) AS short_line_lt4_tokens_pct FROM said""")
def corpus_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Summary of the corpus."""
    return corpus.corpus_summary(chunk_rows(spark, sf), by_show=True)


@query(f"WITH {_DIALOGUE} SELECT season, round(100.0 * count(*) FILTER (WHERE n > 40) / count(*), 2) AS pct_truncated_40, round(100.0 * count(*) FILTER (WHERE n > 80) / count(*), 2) AS pct_truncated_80 FROM said GROUP BY season")
def pct_truncated(spark: SparkSession, sf: str) -> DataFrame:
    """Share of lines over a limit, by season."""
    n = F.col("token_count_line")
    return chunk_rows(spark, sf).groupBy("season").agg(corpus.pct_over(n, 40).alias("pct_truncated_40"), corpus.pct_over(n, 80).alias("pct_truncated_80"))


@query(f"""WITH {_LINES} SELECT text_clean, count(*) AS count FROM (SELECT doc_id, line_no, {_clean('line')} AS text_clean FROM lines) WHERE text_clean <> '' GROUP BY 1 HAVING count(*) >= 2 ORDER BY count(*) DESC, min(doc_id * 1000000 + line_no) LIMIT 20""")
def top_duplicate_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 commonest lines."""
    return corpus.top_duplicates(line_rows(spark, sf).select("doc_id", "line_no", X.clean_cue_text("line").alias("text_clean")), "text_clean", ["doc_id", "line_no"])


@query(f"""WITH {_DIALOGUE}, k AS (SELECT episode, count(*) AS chunk_count FROM said GROUP BY 1) SELECT show_id, season, c.episode, show_id || '_' || printf('S%02dE%02d', season, c.episode) AS episode_id, arg_min('c' || c.episode, pos) AS subtitle_path, count(*) AS cue_count,
count(*) FILTER (WHERE NOT is_watermark AND text_clean <> '') AS dialogue_cue_count, coalesce(max(chunk_count), 0) AS chunk_count, CASE WHEN season = 1 AND c.episode BETWEEN 12 AND 15 THEN 'es' ELSE '' END AS detected_language,
CASE WHEN season = 1 AND c.episode BETWEEN 12 AND 15 THEN 'True' ELSE 'False' END AS was_translated, CASE WHEN count(*) < 5 THEN 'low_cue_count' ELSE 'valid_srt' END AS audit_status, count(*) >= 5 AS verified FROM cues c LEFT JOIN k ON c.episode = k.episode GROUP BY show_id, season, c.episode""")
def manifest_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest row per episode."""
    c = cue_rows(spark, sf)
    files = c.groupBy(F.col("source_path").alias("path")).agg(X.file_status(F.count("*"), F.lit(False), F.count("*"), 5).alias("status"))
    known = spark.createDataFrame([(None, 1, e, "es") for e in range(12, 16)], "show_id string, season int, episode int, language string")
    return corpus.manifest(c, corpus.context_chunks(c), files, known).drop("release_group")


@query("SELECT coalesce(nullif(source, ''), 'unknown') AS key, count(*) AS count FROM documents GROUP BY 1")
def chunks_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by show."""
    return corpus.group_counts(table(spark, sf, "documents"), "source", "lang")


def _shows(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").groupBy(F.col("source").alias("show_id")).agg(F.count("*").cast("int").alias("episodes_total"))
    return n.withColumns({"show_title": F.upper("show_id"), "seasons": (F.col("episodes_total") % 4 + 1).cast("int"), "season_episodes": F.when(F.col("show_id") == "src3", F.array(F.lit(2), F.lit(5)))})


@query("SELECT count(*) AS shows, CAST(sum(n) AS BIGINT) AS episodes, string_agg(source, ',' ORDER BY source) AS ids FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def catalog_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Shows and episodes of the catalog."""
    return corpus.catalog_summary(_shows(spark, sf)).select("shows", "episodes", F.array_join("list.show_id", ",").alias("ids"))


@query("""WITH s AS (SELECT source AS show_id, CAST(count(*) AS INT) AS n, CAST(count(*) % 4 + 1 AS INT) AS k FROM documents GROUP BY 1), p AS (SELECT show_id, n, k, unnest(range(1, k + 1)) AS season FROM s WHERE show_id <> 'src3' UNION ALL SELECT 'src3', 0, 0, unnest([1, 2]) WHERE EXISTS (SELECT 1 FROM s WHERE show_id = 'src3'))
SELECT show_id, CAST(season AS INT) AS season, CAST(unnest(range(1, CASE WHEN show_id = 'src3' THEN CASE season WHEN 1 THEN 3 ELSE 6 END ELSE n // k + CASE WHEN season <= n % k THEN 1 ELSE 0 END + 1 END)) AS INT) AS episode FROM p""")
def episode_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes of the catalog, listed or split evenly."""
    return tables.expand_episodes(_shows(spark, sf))


# Filters, joins, picks


@query(f"WITH {_CUES} SELECT episode, pos FROM cues WHERE season >= 1 AND season <= 8 AND season IN (1, 3, 8)")
def season_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Cues of some seasons."""
    return relational.season_filter(cue_rows(spark, sf), least=1, most=8, among=[1, 3, 8]).select("episode", "pos")


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 2)")
def show_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the first two sources, which stand for shows."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    shows = [r.source for r in docs.select("source").distinct().orderBy("source").limit(2).collect()]
    return relational.show_filter(docs, shows, "source")


@query(f"WITH {_CUES} SELECT DISTINCT season FROM cues")
def sorted_seasons(spark: SparkSession, sf: str) -> DataFrame:
    """Seasons in order."""
    return relational.sorted_seasons(cue_rows(spark, sf))


@query(f"WITH {_CUES} SELECT season, episode, pos FROM cues ORDER BY show_id, season, episode, pos")
def cues_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Cues by place."""
    return relational.in_order(cue_rows(spark, sf), "pos").select("season", "episode", "pos")


@query(f"WITH {_CUES}, f AS (SELECT source_path, CASE WHEN count(*) < 5 THEN 'low_cue_count' ELSE 'valid_srt' END AS status FROM (SELECT 'c' || episode AS source_path FROM cues) GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'valid_srt') AS skipped FROM f")
def skipped_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files, and those that are left out for their few cues."""
    files = cue_rows(spark, sf).groupBy("source_path").agg(X.file_status(F.lit(1), F.lit(False), F.count("*"), 5).alias("status"))
    return corpus.skipped(files)


@query("SELECT event_id, CASE WHEN k = 0 THEN 'empty' WHEN k = 1 THEN 'html_wrapper' WHEN k = 2 THEN 'encoding_error' WHEN k = 3 THEN 'no_dialogue_cues' WHEN k < 53 THEN 'low_cue_count' ELSE 'valid_srt' END AS status FROM (SELECT event_id, event_id % 60 AS k FROM events)")
def file_status_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Every status a file can have."""
    k = F.col("event_id") % 60
    status = X.file_status(F.when(k == 0, 0).otherwise(9), k <= 1, F.greatest(k - 3, F.lit(0)), 50, k <= 2)
    return table(spark, sf, "events").select("event_id", status.alias("status"))


@query("SELECT item_id, CASE WHEN item_id % 3 > 0 THEN CAST(item_id % 3 AS INT) END AS expected_season FROM benchmark WHERE item_id % 3 = 0 OR item_id % 3 = 2")
def season_or_any(spark: SparkSession, sf: str) -> DataFrame:
    """Queries of a season or of none."""
    q = table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 3 > 0, (F.col("item_id") % 3).cast("int")).alias("expected_season"))
    return relational.season_or_any(q, 2)


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the labels list."""
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def anti_existing(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a large order: downloads that aren't there yet."""
    have = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("length"))
    return relational.not_downloaded(table(spark, sf, "customer").select("c_custkey"), have, "c_custkey", 100_000)


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN source ELSE 'patched' END AS source, CASE WHEN l.doc_id IS NULL THEN NULL ELSE quality END AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def upsert_patch(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with patched ones replaced."""
    patch = table(spark, sf, "labels").select("doc_id", F.lit("patched").alias("source"), "quality")
    base = table(spark, sf, "documents").select("doc_id", "source", F.lit(None).cast("long").alias("quality"))
    return relational.upsert(base, patch.withColumn("quality", F.col("quality").cast("long")), ["doc_id"])


_PICK = "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'srt' WHEN l_returnflag = 'A' THEN 'SUB' END AS format, l_linestatus = 'F' AS hi, CAST(l_quantity AS INT) AS dl FROM lineitem"


@query(f"""SELECT l_orderkey, l_linenumber FROM ({_PICK}) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE lower(format) WHEN 'srt' THEN 2 WHEN 'sub' THEN 1 ELSE 0 END DESC, hi, dl DESC, l_linenumber) = 1""")
def best_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Best item of each order by the rule for subtitle files."""
    f = F.col("l_returnflag")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(f == "R", "srt").when(f == "A", "SUB").alias("format"), (F.col("l_linestatus") == "F").alias("hearing_impaired"), F.col("l_quantity").cast("int").alias("download_count"))
    return relational.best_subtitle(items, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY doc_id) = 1")
def first_wins_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """First document of each normalised text."""
    rows = table(spark, sf, "documents").select("doc_id", "source", F.xxhash64(X.normalize_key("text")).alias("k"), F.sha2(X.normalize_key("text"), 256).alias("s"))
    return relational.first_per_key(rows, ["k", "s"], ["doc_id"]).select("doc_id", "source")


@query("SELECT custkey, place FROM (SELECT o_custkey AS custkey, o_orderkey AS place FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3)")
def budget_per_show(spark: SparkSession, sf: str) -> DataFrame:
    """The first three of each key: a budget per show."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("place"))
    return relational.first_per_key(rows, ["custkey"], ["place"], 3)


_LINKS = [("src1", "alpha", "Alpha", "101", None), ("src2", "beta", "Beta", None, "https://beta.example/src2"), ("src0", "alpha", "Alpha", "100", None)]


@query("""WITH k AS (SELECT doc_id, CASE WHEN source IN ('src0', 'src1', 'src2') THEN source ELSE 'src0' END AS sid, CAST(doc_id % 3 AS INT) AS episode FROM documents)
SELECT doc_id, CASE sid WHEN 'src2' THEN 'beta' ELSE 'alpha' END AS stream_provider, CASE sid WHEN 'src2' THEN 'Beta' ELSE 'Alpha' END AS stream_label, CASE WHEN sid = 'src1' AND episode = 2 THEN 'https://alpha.example/watch/77' WHEN sid = 'src2' THEN 'https://beta.example/src2' WHEN sid = 'src1' THEN 'https://alpha.example/title/101' ELSE 'https://alpha.example/title/100' END AS stream_url,
CASE WHEN sid = 'src1' AND episode = 2 THEN 'episode' ELSE 'show' END AS stream_link_type FROM k""")
def link_enrich(spark: SparkSession, sf: str) -> DataFrame:
    """Links of documents by show and, where known, by episode."""
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).alias("show_id"), F.concat(F.lit("Title "), "source").alias("show_title"), F.lit(1).alias("season"), (F.col("doc_id") % 3).cast("int").alias("episode"))
    catalog = spark.createDataFrame(_LINKS, "show_id string, provider string, label string, title_id string, url string")
    one = spark.createDataFrame([("src1", "S01E02", "77")], "show_id string, episode_label string, video_id string")
    titles = {f"title src{k}": f"src{k}" for k in range(3)}
    out = links.with_links(rows, catalog, "src0", titles, "https://alpha.example/title/", "https://alpha.example/watch/", one)
    return out.select("doc_id", "stream_provider", "stream_label", "stream_url", "stream_link_type")


# Retrieval


#: The stated query set of searches: every row whose id is divisible by 20, against all rows.
ASKED = 20
#: The recall gate of the reference's search, its ann_top.
GATE = 200


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    return e.filter(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"), F.col("label").alias("q_label")), e


_SCORED = """s AS (SELECT q.vec_id AS q, e.vec_id, q.label AS q_label, e.label, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS a FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)"""


@query(f"WITH {_SCORED} SELECT q, vec_id, round(a, 6) AS ann_score FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(a, 9) DESC, vec_id) <= 20")
def ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty nearest vectors by built-in functions."""
    q, e = _vectors(spark, sf)
    return search.nearest(q, e, 20, "q", "qv", "vec_id", "embedding").withColumn("ann_score", F.round("ann_score", 6))


@query(ORACLES["ann_topk"])
def ann_topk_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty nearest vectors by matrix products."""
    q, e = _vectors(spark, sf)
    return search.nearest_blocks(q, e, 20, "q", "qv", "vec_id", "embedding").withColumn("ann_score", F.round("ann_score", 6))


_CAPPED = f"""{_SCORED}, t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY a DESC, vec_id) <= 200), c AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY q, label ORDER BY a DESC, vec_id) <= 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY a DESC, vec_id) AS rank FROM c)"""


def _near(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest vectors with both labels; the queries meet the items in blocks."""
    q, e = _vectors(spark, sf)
    found = search.nearest_blocks(q, e, GATE, "q", "qv", "vec_id", "embedding")
    return found.join(e.select("vec_id", "label"), "vec_id").join(q.select("q", "q_label"), "q")


def _capped(spark: SparkSession, sf: str) -> DataFrame:
    return search.capped_top(_near(spark, sf), ["q"], ["label"], [F.desc("ann_score"), F.col("vec_id")], 5)


@query(f"WITH {_CAPPED} SELECT q, vec_id, label, CAST(rank AS INT) AS rank, round(a, 6) AS ann_score FROM r WHERE rank <= 5")
def ann_topk_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Five nearest vectors with two of a label at most."""
    return _capped(spark, sf).select("q", "vec_id", "label", "rank", F.round("ann_score", 6).alias("ann_score"))


@query(f"WITH {_CAPPED} SELECT q, CAST(rank AS INT) AS rank, CASE WHEN rank = 1 AND (a >= 2 OR (a >= 0.5 AND b >= 0.85)) THEN 'high' WHEN a >= -0.5 OR b >= 0.75 OR a >= 0 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN g IS NULL OR g >= 0.25 THEN 'high' WHEN g >= 0.1 THEN 'medium' ELSE 'low' END AS gap_confidence FROM (SELECT *, 1 - rank / 10.0 AS b, a - lead(a) OVER (PARTITION BY q ORDER BY rank) AS g FROM r WHERE rank <= 5)")
def confidence_band(spark: SparkSession, sf: str) -> DataFrame:
    """Both kinds of confidence of the capped results."""
    from pyspark.sql import Window

    a = F.col("ann_score")
    rows = _capped(spark, sf).withColumn("g", a - F.lead("ann_score").over(Window.partitionBy("q").orderBy("rank")))
    return rows.select("q", "rank", S.confidence_band(a, a, 1 - F.col("rank") / 10, F.col("rank")).alias("confidence"), S.gap_band(F.col("g")).alias("gap_confidence"))


@query(f"WITH {_CAPPED}, h AS (SELECT q, min(rank) FILTER (WHERE rank <= 5 AND label = q_label AND vec_id <> q) AS k FROM r GROUP BY q) SELECT count(*) AS n, avg(CASE WHEN k <= 1 THEN 1.0 ELSE 0.0 END) AS recall_at_1, avg(CASE WHEN k <= 5 THEN 1.0 ELSE 0.0 END) AS recall_at_5, round(avg(coalesce(1.0 / k, 0.0)), 6) AS mrr FROM h")
def recall_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Recall and reciprocal rank where another vector of the query's label is a hit."""
    r = _capped(spark, sf)
    first = r.groupBy("q").agg(F.min(F.when((F.col("label") == F.col("q_label")) & (F.col("vec_id") != F.col("q")), F.col("rank"))).alias("rank_episode"), F.lit(None).cast("int").alias("rank_cue"), F.lit("exact").alias("category"))
    return evaluate.recall(first).select("n", F.col("recall_at_1_episode").alias("recall_at_1"), F.col("recall_at_5_episode").alias("recall_at_5"), F.round("mrr_episode", 6).alias("mrr"))


@query("SELECT vec_id, label, 'talk' AS show_id FROM embeddings")
def index_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two indexes as one, with a show for rows that lack it."""
    e = table(spark, sf, "embeddings").withColumn("chunk_id", F.col("vec_id").cast("string"))
    meta = {"model_name": "m", "embedding_dim": 64, "chunk_count": 0}
    parts = [(e.filter("label % 2 = 0"), meta), (e.filter("label % 2 = 1").withColumn("show_id", F.lit("")), meta)]
    return index.merge_indexes(parts, ("talk", "Talk"))[0].select("vec_id", "label", "show_id")


@query("SELECT o_custkey AS custkey, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) > 1")
def index_unique_check(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that are there more than once."""
    return relational.repeated_keys(table(spark, sf, "orders").withColumnRenamed("o_custkey", "custkey"), "custkey")


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_WORDS = f"w AS (SELECT item_id, list_filter({_tokens(_clean('text'))}, lambda t: NOT list_contains({_STOP}, t) AND (length(t) >= 3 OR regexp_matches(t, '[0-9]'))) AS words FROM benchmark)"
_MODE = "CASE WHEN len(words) = 0 THEN 'off' WHEN len(list_filter(words, lambda t: regexp_matches(t, '[0-9]'))) > 0 OR len(words) <= 4 THEN 'strict' WHEN len(words) <= 8 THEN 'soft' ELSE 'off' END"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Whole benchmark items as queries."""
    rows = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("query")).withColumn("words", X.distinctive_tokens("query"))
    return rows.withColumns({"n": F.size("words"), "mode": X.lexical_mode("words")})


@query(f"WITH {_WORDS} SELECT item_id, array_to_string(words, ' ') AS words, {_MODE} AS mode FROM w")
def lexical_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Distinctive tokens and mode of each whole item."""
    return _items(spark, sf).select("item_id", F.array_join("words", " ").alias("words"), X.lexical_mode("words").alias("mode"))


_HITS = f"{_WORDS}, {_CUES}, h AS (SELECT item_id, episode, pos, words, CAST(len(words) AS INT) AS n, CAST(len(list_filter(words, lambda t: contains(text_clean, t))) AS INT) AS hits FROM cues, w)"


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Every cue with every whole item, the stated queries, in blocks of items of a checked size."""
    cues = cue_rows(spark, sf).select("episode", "pos", "text_clean")
    pairs = search.against_blocks(cues, _items(spark, sf), "item_id")
    return pairs.withColumn("hits", X.token_hits("words", "text_clean"))


@query(f"WITH {_HITS} SELECT item_id, episode, pos, hits FROM h WHERE hits > 0")
def token_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Cues with words of a whole benchmark item."""
    return _hits(spark, sf).filter("hits > 0").select("item_id", "episode", "pos", "hits")


@query(f"""WITH {_HITS}, g AS (SELECT *, {_MODE} AS mode, CASE WHEN n > 0 THEN hits / n ELSE 0 END AS f FROM h)
SELECT item_id, count(*) AS n_lines, round(CAST(sum(CASE WHEN mode = 'strict' AND n > 0 AND hits = 0 THEN -3.0 WHEN mode = 'strict' AND f >= 0.9 THEN 0.75 WHEN mode = 'strict' AND hits >= greatest(1, n // 2) THEN 0.25 WHEN mode = 'soft' AND f >= 0.85 THEN 0.5 WHEN mode = 'soft' AND n > 0 AND hits = 0 AND f < 0.4 THEN -1.0 ELSE 0.0 END) AS DOUBLE), 6) AS total,
count(CASE WHEN mode = 'strict' AND (hits = 0 AND n > 0 OR f >= 0.9 OR hits >= greatest(1, n // 2)) OR mode = 'soft' AND (f >= 0.85 OR (n > 0 AND hits = 0 AND f < 0.4)) THEN 1 END) AS noted FROM g GROUP BY item_id""")
def guardrail_no_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """The guardrail's sums by query, with the share of words in place of the fuzzy score.

    Pairs are counted by item and hits, which is all that a sum depends on. With mode off it depends on neither: such
    items only take the number of lines.
    """
    h = _hits(spark, sf).filter("mode != 'off'").groupBy("item_id", "mode", "n", "hits").agg(F.count("*").alias("k"))
    off = _items(spark, sf).filter("mode = 'off'").select("item_id", "mode", "n", F.lit(0).alias("hits"))
    h = h.unionByName(off.crossJoin(table(spark, sf, "conversations").agg(F.count("*").alias("k")).filter("k > 0")))
    fuzzy = F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)
    score, note = S.guardrail(F.lit(0.0), F.col("mode"), F.col("n"), F.col("hits"), fuzzy, S.GuardrailConfig().columns())
    rows = h.withColumn("d", score * F.col("k")).withColumn("noted", F.when(note.isNotNull(), F.col("k")).otherwise(0))
    return rows.groupBy("item_id").agg(F.sum("k").alias("n_lines"), F.round(F.sum("d"), 6).alias("total"), F.sum("noted").alias("noted"))


@query()
def guardrail_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The guardrail's sums by whole benchmark item over all cues, with the operator's fuzzy score.

    Pairs whose result doesn't depend on that score (mode off, or strict without a hit) don't reach the fuzzy match.
    """
    rows = _hits(spark, sf)
    asks = (F.col("mode") == "soft") | ((F.col("mode") == "strict") & (F.col("hits") > 0))
    fuzzy = S.line_fuzzy(X.clean_cue_text("query"), F.col("text_clean"))
    keep = ["item_id", "mode", "n", "hits", "fuzzy"]
    rows = rows.filter(asks).withColumn("fuzzy", fuzzy).select(keep).unionByName(rows.filter(~asks).withColumn("fuzzy", F.lit(0.0)).select(keep))
    score, note = S.guardrail(F.lit(0.0), F.col("mode"), F.col("n"), F.col("hits"), F.col("fuzzy"), S.GuardrailConfig().columns())
    return rows.withColumn("d", score).withColumn("note", note).groupBy("item_id").agg(F.count("*").alias("n_lines"), F.round(F.sum("d"), 6).alias("total"), F.count("note").alias("noted"))


@query(f"""WITH {_SCORED}, t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY a DESC, vec_id) <= 200), g AS (SELECT CAST(k AS INT) AS config_id, p, b FROM (SELECT (i - 1) * 2 + j - 1 AS k, ([2.0, 3.0, 4.0])[i] AS p, ([0.5, 0.75])[j] AS b FROM range(1, 4) x(i), range(1, 3) y(j))),
d AS (SELECT config_id, q, vec_id, q_label, label, a, round(a + CASE WHEN vec_id % 4 = 0 THEN -p WHEN vec_id % 4 = 1 THEN b ELSE 0 END, 9) AS z FROM t, g), r AS (SELECT *, row_number() OVER (PARTITION BY config_id, q ORDER BY z DESC, a DESC, vec_id) AS rank FROM d), f AS (SELECT config_id, q, min(rank) FILTER (WHERE label = q_label AND vec_id <> q AND rank <= 5) AS k FROM r GROUP BY 1, 2)
SELECT config_id, avg(CASE WHEN k <= 5 THEN 1.0 ELSE 0.0 END) + 0.5 * avg(CASE WHEN k <= 1 THEN 1.0 ELSE 0.0 END) AS objective FROM f GROUP BY 1""")
def guardrail_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Objective of each config of a small grid over candidates that are scored once."""
    near = _near(spark, sf)
    from pyspark.sql import Window

    configs = evaluate.grid(spark, {"strict_miss_penalty": [2.0, 3.0, 4.0], "strict_strong_boost": [0.5, 0.75]})
    place = F.col("vec_id") % 4
    score, _ = S.guardrail(F.col("ann_score"), F.lit("strict"), F.lit(9), F.when(place == 0, 0).otherwise(1), F.when(place == 1, 1.0).otherwise(0.0), {k: F.col(k) for k in S.GuardrailConfig().columns()})
    rows = near.crossJoin(F.broadcast(configs)).withColumn("score", F.round(score, 9))
    by = Window.partitionBy("config_id", "q").orderBy(F.desc("score"), F.desc("ann_score"), "vec_id")
    rows = rows.withColumn("rank", F.row_number().over(by)).filter("rank <= 5")
    right = (F.col("label") == F.col("q_label")) & (F.col("vec_id") != F.col("q"))
    first = rows.groupBy("config_id", "q").agg(F.lit(None).cast("int").alias("rank_episode"), F.min(F.when(right, F.col("rank"))).alias("rank_cue"), F.lit("exact").alias("category"))
    return evaluate.recall(first, ["config_id"]).select("config_id", "objective")


_KEYS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in evaluate.KEY_NEIGHBORS.items()) + "}"


@query(f"""WITH q AS (SELECT item_id, text AS t FROM benchmark), i AS (SELECT item_id, t, unnest(range(1, length(t) + 1)) AS i FROM q), n AS (SELECT item_id, t, i, substr(t, i, 1) AS ch, coalesce(element_at({_KEYS}, lower(substr(t, i, 1)))[1], '') AS near FROM i),
e AS (SELECT *, unnest(range(1, length(near) + 1)) AS j FROM n),
c AS (SELECT item_id, t, i, 0 AS k, substr(t, 1, i - 1) || substr(t, i + 1) AS v FROM i UNION ALL SELECT item_id, t, i, 1, substr(t, 1, i - 1) || substr(t, i + 1, 1) || substr(t, i, 1) || substr(t, i + 2) FROM i WHERE i < length(t)
UNION ALL SELECT item_id, t, i, 1 + j, substr(t, 1, i - 1) || CASE WHEN upper(ch) = ch AND lower(ch) <> ch THEN upper(substr(near, j, 1)) ELSE substr(near, j, 1) END || substr(t, i + 1) FROM e),
d AS (SELECT *, trim(regexp_replace(lower(v), '\\s+', ' ', 'g')) AS key FROM c WHERE length(v) >= 3 AND i <= 12), f AS (SELECT * FROM d WHERE key <> trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) QUALIFY row_number() OVER (PARTITION BY item_id, key ORDER BY i, k) = 1)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i, k) AS INT) AS place, v AS variant FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i, k) <= 6""")
def typo_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Six typos of each whole item, neighbouring keys among them; its first places give as many, so SQL stops at twelve."""
    rows = table(spark, sf, "benchmark").select("item_id", F.posexplode(evaluate.typo_variants("text", 6)).alias("place", "variant"))
    return rows.select("item_id", (F.col("place") + 1).alias("place"), "variant")


@query(f"""WITH b AS (SELECT item_id, list_distinct({_tokens('text')}) AS t FROM benchmark), d AS (SELECT doc_id, list_distinct({_tokens('text')}) AS t FROM documents),
p AS (SELECT item_id, doc_id, len(list_intersect(b.t, d.t)) / (len(b.t) + len(d.t) - len(list_intersect(b.t, d.t))) AS j FROM b, (SELECT doc_id, t FROM d WHERE len(t) > 0) d WHERE len(list_intersect(b.t, d.t)) > 0)
SELECT item_id, doc_id, round(j, 6) AS jaccard FROM p QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY j DESC, doc_id) <= 10""")
def jaccard_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The ten documents of the most similar tokens for every benchmark item, the stated queries, out of all documents."""
    items = table(spark, sf, "benchmark").select("item_id", X.tokens("text").alias("tokens"))
    docs = table(spark, sf, "documents").select("doc_id", X.tokens("text").alias("tokens"))
    return search.jaccard_top(items, docs, 10, "item_id", "doc_id", "tokens").withColumn("jaccard", F.round("jaccard", 6))


def _eval_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of each twentieth conversation, as a query that expects its episode and the line."""
    c = cue_rows(spark, sf).filter("episode % 20 = 0")
    rows = c.select(
        F.concat(F.lit("q"), "episode", F.lit("_"), "pos").alias("query_id"), F.col("text_clean").alias("query"), F.concat_ws("_", "show_id", X.episode_label("season", "episode")).alias("expected_episode_id"), F.col("season").alias("expected_season"), F.col("episode").alias("expected_episode"),
        F.lower("text_raw").alias("expected_cue_contains"), F.lit("partial").alias("category"), F.lit(None).cast("string").alias("notes"),
    )
    return _saved(rows, "queries")


def _index(spark: SparkSession, sf: str) -> DataFrame:
    # chunk_id() takes season 0 for missing and repeats its ids there; cue_id() keeps them apart.
    chunks = chunk_rows(spark, sf).withColumn("chunk_id", X.cue_id("show_id", "season", "episode", "cue_index"))
    return _saved(index.build_index(chunks, HashedEmbedder()), "index")


@query()
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked, formatted results: recall, reranking, guardrail, cap and confidence."""
    out = search.search(_eval_queries(spark, sf), _index(spark, sf), HashedEmbedder(), OverlapReranker(), n=GATE)
    return search.formatted(out)


@query()
def partial_ratio_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Best fuzzy matches among each query's GATE nearest chunks, as many as the reference scores."""
    scored = search.candidates(_eval_queries(spark, sf), _index(spark, sf), HashedEmbedder(), n=GATE)
    return search.capped_top(scored, ["query_id"], ["chunk_id"], [F.desc("fuzzy_score"), F.col("chunk_id")], 3).select("query_id", "rank", "chunk_id", F.round("fuzzy_score", 6).alias("fuzzy_score"))


@query()
def search_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of expanded queries by type of variant."""
    q = _eval_queries(spark, sf)
    memory = q.select("query_id", F.array(F.reverse("query"), "query", F.upper("query")).alias("variants"))
    wide = _saved(evaluate.expand_queries(q, memory, 2), "expanded-queries")
    found = search.search(wide, _index(spark, sf), HashedEmbedder(), n=GATE)
    ranks = evaluate.hits(found, wide).join(wide.select("query_id", "variant_type"), "query_id")
    return evaluate.recall(ranks, ["variant_type"])


@query()
def guardrail_tuning(spark: SparkSession, sf: str) -> DataFrame:
    """The best guardrail configs of the quick grid."""
    q = _eval_queries(spark, sf)
    scored = search.candidates(q, _index(spark, sf), HashedEmbedder(), n=GATE, decisive=True)
    return evaluate.tune(scored, q, evaluate.grid(spark, evaluate.QUICK_GRID))


@query()
def corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    """The nested corpus report as JSON."""
    return corpus.corpus_report(chunk_rows(spark, sf)).select(F.to_json(F.struct("*")).alias("report"))


# Files, pages, graphs


def _srt(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as subtitle files."""
    stamp = lambda ms: F.regexp_replace(F.lpad(X.format_ms(ms), 12, "0"), r"\.", ",")
    line = F.regexp_replace(F.regexp_replace("text_raw", "\\s*\n\\s*", "\n"), "^\\s+|\\s+$", "")
    block = F.concat(F.col("pos") + 1, F.lit("\n"), stamp("start_ms"), F.lit(" --> "), stamp("end_ms"), F.lit("\n"), line)
    files = cue_rows(spark, sf).groupBy("season", "episode").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))
    path = F.format_string("/subs/talk/Talk.%s.WEB.srt", X.episode_label("season", "episode"))
    return files.select(path.alias("path"), F.lit("talk").alias("show_id"), F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("length"))


@query(f"""WITH {_CUES} SELECT 'talk_' || printf('S%02dE%02d', season, episode) || '_' || printf('%05d', row_number() OVER (PARTITION BY episode ORDER BY pos) - 1) AS cue_id, CAST(pos + 1 AS INT) AS cue_index, start_ms, end_ms, {_clean("trim(text_raw, ' ' || chr(10) || chr(13) || chr(9))")} AS text_clean FROM cues WHERE {_clean("trim(text_raw, ' ' || chr(10) || chr(13) || chr(9))")} <> ''""")
def srt_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Cues parsed from subtitle files that were made from conversations."""
    return subtitles.cues(subtitles.parse_episodes(_srt(spark, sf))).select("cue_id", "cue_index", "start_ms", "end_ms", "text_clean")


@query(f"WITH {_CUES} SELECT season, episode, 'WEB' AS release_group, CASE WHEN count(*) < 50 THEN 'low_cue_count' ELSE 'valid_srt' END AS status, CAST(count(*) AS INT) AS cue_count, CAST(max(end_ms) - min(start_ms) AS BIGINT) AS duration_ms, 0 AS parse_error_count FROM cues WHERE text_clean <> '' GROUP BY season, episode")
def file_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit of those files."""
    return corpus.audit(subtitles.parse_episodes(_srt(spark, sf))).select("season", "episode", "release_group", "status", "cue_count", "duration_ms", "parse_error_count")


@query("""SELECT page_id, CAST(s AS INT) AS season, CAST(e AS INT) AS episode, 'https://subs.example/versions-9-' || e || '-' || s || '-talk-subtitles' AS url FROM pages, range(1, 3) x(s), range(1, 4) y(e) WHERE e <= page_id % 3 + 1""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Episode links of pages to which a list of links was added, some twice."""
    item = lambda s, e: F.concat(F.lit("<a class='list-group-item x' href='/versions-9-"), e.cast("string"), F.lit("-"), s.cast("string"), F.lit("-talk-subtitles'>E</a>"))
    made = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(2)), lambda s: F.transform(F.sequence(F.lit(1), F.col("page_id") % 3 + 1), lambda e: item(s, e))))
    html = F.concat("html", F.array_join(made, "\n"), F.array_join(made, "\n"))
    return pages.episode_links(table(spark, sf, "pages").select("page_id", html.alias("html")), "https://subs.example")


@query("SELECT page_id, 'v' || page_id % 3 AS version, 'https://subs.example/downloads/' || page_id % 3 AS url, CAST(10 * (page_id % 3) AS INT) AS downloads FROM pages WHERE page_id % 3 > 0")
def page_downloads(spark: SparkSession, sf: str) -> DataFrame:
    """The most downloaded box of a language on pages made of boxes."""
    box = lambda k, lang: F.concat(F.lit("<div style='x; background-color: #f5f5f5'><span class='version'><i>v"), k.cast("string"), F.lit(f"</i></span> Language : {lang} Downloads : "), (10 * k).cast("string"), F.lit("<a href='/downloads/"), k.cast("string"), F.lit("'>get</a></div>"))
    k = F.col("page_id") % 3
    html = F.when(k == 0, box(F.lit(9), "French")).otherwise(F.concat(box(F.lit(9), "French"), box(k - k, "English"), box(k, "English")))
    return pages.best_download(table(spark, sf, "pages").select("page_id", html.alias("html")), "English", "https://subs.example")


@query("SELECT CAST(n_regionkey + 1 AS INT) AS season, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS episode, CAST(1000 + n_nationkey AS VARCHAR) AS video_id FROM nation")
def graph_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Episode ids of a graph whose seasons are regions and whose episodes are nations."""
    nations = table(spark, sf, "nation")
    ref = lambda path: F.concat(F.lit('{"$type":"ref","value":["videos","'), path, F.lit('"]}'))
    node = lambda key, body: F.concat(F.lit('"'), key, F.lit('":{"id":{"$type":"atom","value":'), key, F.lit("}"), body, F.lit("}"))
    key = lambda base, c: (F.lit(base) + F.col(c)).cast("string")
    episodes = nations.agg(F.array_join(F.collect_list(node(key(1000, "n_nationkey"), F.lit(""))), ",").alias("e"))
    per = nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", ref(key(1000, "n_nationkey")).alias("r")))).alias("x"))
    listed = per.select("n_regionkey", node(key(100, "n_regionkey"), F.concat(F.lit(',"episodes":{"$type":"list","values":['), F.array_join(F.transform("x", lambda r: r["r"]), ","), F.lit("]}"))).alias("s"), ref(key(100, "n_regionkey")).alias("r"))
    seasons = listed.agg(F.array_join(F.collect_list("s"), ",").alias("s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_regionkey", "r"))), lambda r: r["r"]), ",").alias("r"))
    document = F.concat(F.lit('{"videos":{"7":{"seasonList":{"seasons":['), "r", F.lit("]}},"), "s", F.lit(","), "e", F.lit("}}"))
    return pages.walk_graph(seasons.crossJoin(episodes).select(document.alias("document")), "7")


@query("SELECT count(*) AS files, CAST(sum(k) AS BIGINT) AS chunks, round(avg(k), 6) AS chunks_per_file, CAST(floor(572 * avg(k)) AS BIGINT) AS estimated_chunks, round(floor(572 * avg(k)) * 1536 / 1e6, 1) AS vectors_mb FROM (SELECT conv_id, count(*) AS k FROM conversations GROUP BY 1)")
def pipeline_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Size of an index extrapolated from the conversations."""
    sample = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("chunks"), F.lit(0.5).alias("parse_seconds"))
    return corpus.pipeline_estimate(sample, 572).select("files", "chunks", F.round("chunks_per_file", 6).alias("chunks_per_file"), "estimated_chunks", "vectors_mb")


# Events


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events by hour and type."""
    out = stream.window_counts(table(spark, sf, "events"), "ts", "event_type", "1 hour", value=F.col("value"))
    return _naive(out).withColumn("total", F.round("total", 4))


def _naive(df: DataFrame) -> DataFrame:
    return df.select([F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query("SELECT s AS window_start, s + INTERVAL '2 hours' AS window_end, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour', time_bucket(INTERVAL '1 hour', ts)]) AS s FROM events) GROUP BY 1, 2, 3")
def event_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Events in two-hour windows that start every hour."""
    return _naive(stream.window_counts(table(spark, sf, "events"), "ts", "event_type", "2 hours", "1 hour"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts of a user's events."""
    return _naive(stream.sessions(table(spark, sf, "events"), "ts", "user_id", "30 minutes"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "query").otherwise("feedback")
    return e.select("ts", kind.alias("type"), F.concat(F.lit("u"), "user_id").alias("chunk_id"), F.when(F.col("event_type") == "purchase", "up").otherwise("down").alias("vote"), F.floor("value").cast("int").alias("latency_ms"), (F.col("event_id") % 7).cast("int").alias("result_count"))


@query("SELECT 'u' || user_id AS chunk_id, count(*) FILTER (WHERE event_type = 'purchase') AS up, count(*) FILTER (WHERE event_type <> 'purchase') AS down, count(*) FILTER (WHERE event_type = 'purchase') - count(*) FILTER (WHERE event_type <> 'purchase') AS net FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def feedback_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Votes by chunk."""
    return stream.vote_tally(stream.forwarded(_log(spark, sf)))


@query("SELECT count(*) AS queries, count(*) FILTER (WHERE event_id % 7 = 0) AS empty, round(avg(CAST(floor(value) AS INT)), 6) AS mean_latency_ms FROM events WHERE event_type IN ('click', 'view')")
def query_log_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of the query log."""
    return stream.query_stats(_log(spark, sf)).select("queries", "empty", F.round("mean_latency_ms", 6).alias("mean_latency_ms"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts from a stream over the events' file, run to its end."""
    static = table(spark, sf, "events")
    live = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counts = stream.window_counts(live, "ts", "event_type", "1 hour", late="40 days")
    folder = _shared(spark, "event-stream")
    # Each batch replaces the counts so far; they stay in the shared folder and don't pass through the driver.
    replace = lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/counts")
    job = counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return _naive(spark.read.parquet(f"{folder}/counts")).select("window_start", "event_type", "n")
