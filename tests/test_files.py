import gzip
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelight import sql
from cuelight.models import HashedEmbedder, OverlapReranker, detect_language
from cuelight.operators import corpus, evaluate, index, relational, search
from cuelight.sources import pages, subtitles, tables

SRT = """1
00:00:01,000 --> 00:00:02,500 X1:10
ALFRED: Hello <i>there</i>

00:00:03.000 --> 00:00:04.000
Second line
of two

3
00:00:05,000 --> 00:00:06,000
[music]

no time here

7
0:0:1 --> 0:0:2
bad

8
00:00:07,000 --> 00:00:08,000
Translated by the community

9
00:00:09,000 --> 00:00:10,000

tail of a broken cue
"""


@pytest.fixture(scope="module")
def episodes(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("subs")
    files = {"talk/Talk.S01E02.WEB.srt": SRT.replace("\n", "\r\n").encode("utf-8-sig"), "talk/S01E03.srt": b"", "web/page.srt": b"<!DOCTYPE html><html></html>", "web/S00E01.srt": b"1\n00:00:01,000 --> 00:00:02,000\ncaf\xe9\n"}
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    return subtitles.parse_episodes(subtitles.scan_srt(spark, str(root))).cache()


def test_parse(episodes):
    rows = {r.path.rsplit("/", 1)[1]: r for r in episodes.collect()}
    r = rows["Talk.S01E02.WEB.srt"]
    assert (r.season, r.episode, r.release_group, r.show_id) == (1, 2, "WEB", "talk")
    assert [(c.cue_index, c.start_ms, c.end_ms, c.text_raw, c.text_clean, c.speaker, c.is_watermark) for c in r.cues] == [
        (1, 1000, 2500, "ALFRED: Hello <i>there</i>", "hello there", "Alfred", False),
        (None, 3000, 4000, "Second line of two", "second line of two", None, False),
        (8, 7000, 8000, "Translated by the community", "translated by the community", None, True),
    ]
    assert r.parse_errors == ["block 4: could not find timestamp", "block 5: invalid timestamp line", "block 8: could not find timestamp"]
    assert rows["S01E03.srt"].parse_errors == ["empty file"] and rows["S00E01.srt"].cues[0].text_clean == "café"


def test_audit_cues_chunks_manifest(spark, episodes):
    audit = {r.path.rsplit("/", 1)[1]: r for r in corpus.audit(episodes).collect()}
    assert {k: r.status for k, r in audit.items()} == {"Talk.S01E02.WEB.srt": "low_cue_count", "S01E03.srt": "empty", "page.srt": "html_wrapper", "S00E01.srt": "low_cue_count"}
    r = audit["Talk.S01E02.WEB.srt"]
    assert (r.cue_count, r.dialogue_cue_count, r.duration_ms, r.has_watermark, r.parse_error_count) == (3, 2, 3000, True, 3) and r.error_message.count(";") == 2
    cues = subtitles.cues(episodes)
    assert [r.cue_id for r in cues.orderBy("cue_id").collect()] == ["talk_S01E02_00000", "talk_S01E02_00001", "talk_S01E02_00002", "web_S00E01_00000"]
    chunks = corpus.context_chunks(cues, 1)
    got = {r.chunk_id: (r.context_before, r.context_after, r.text_embed, r.token_count_embed) for r in chunks.collect()}
    assert got["talk_S01E02_00001"] == (["hello there"], [], "hello there\nsecond line of two", 6) and "web_00000" in got
    files = corpus.audit(episodes).select("path", "status")
    rows = {r.show_id: r for r in corpus.manifest(cues, chunks, files, spark.createDataFrame([("talk", 1, 2, "es")], "show_id string, season int, episode int, language string")).collect()}
    assert (rows["talk"].episode_id, rows["talk"].cue_count, rows["talk"].dialogue_cue_count, rows["talk"].chunk_count, rows["talk"].detected_language, rows["talk"].was_translated, rows["talk"].verified) == ("talk_S01E02", 3, 2, 2, "es", "True", False)
    told = spark.createDataFrame([("Second line of two", "OTHER: Words")], "text_raw string, text_translated string")
    line = subtitles.translate(cues, told, "es").filter("text_original is not null").first()
    assert (line.text_raw, line.text_original, line.text_clean, line.was_translated) == ("OTHER: Words", "Second line of two", "other: words", True)
    assert {r.sample for r in subtitles.language_sample(cues).collect()} == {None}
    assert subtitles.missing_shows(spark.createDataFrame([("talk",), ("gone",)], "show_id string"), cues).first().show_id == "gone"


def test_distribution_rule(spark):
    got = corpus.distribution(spark.range(10).withColumnRenamed("id", "x"), "x").first()
    assert (got["count"], got["mean"], got["stdev"], got["p50"], got["p90"], got["p99"], got["max"]) == (10, 4.5, 2.87, 5, 9, 9, 9)


def test_unwrap(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("readme.txt", "no")
        f.writestr("a.srt", "yes")
    rows = spark.createDataFrame([(gzip.compress(b"zipped"),), (z.getvalue(),), (b"plain",), (None,)], "x binary").coalesce(1)
    assert [bytes(r[0]) if r[0] else None for r in rows.select(subtitles.unwrap("x")).collect()] == [b"zipped", b"yes", b"plain", None]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("é", None, True)], "a string, b int, c boolean")
    tables.write_jsonl(df, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert json.loads(text) == {"a": "é", "b": None, "c": True} and "é" in text
    tables.append_events(df, str(tmp_path / "j"))
    assert tables.read_jsonl(spark, str(tmp_path / "j"), df.schema).count() == 2
    tables.write_csv(df.coalesce(1), str(tmp_path / "c"), ["c", "a"])
    assert "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv")) == "c,a\nTrue,é\n"
    assert tables.read_manifest(spark, str(tmp_path / "c"), df.schema).first().b is None
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [r.embedding for r in tables.read_npy(spark, str(tmp_path / "v.npy")).orderBy("pos").collect()] == [[0, 1], [2, 3], [4, 5]]
    (tmp_path / "m.json").write_text(json.dumps({"shows": {"x": {"label": "L"}}}))
    assert tables.read_json_map(spark, str(tmp_path / "m.json"), "shows", "struct<label: string>").first().value.label == "L"
    shows = spark.createDataFrame([("a", 3, 10, None), ("b", 1, 0, [2, 1])], "show_id string, seasons int, episodes_total int, season_episodes array<int>")
    n = tables.expand_episodes(shows).groupBy("show_id", "season").count().orderBy("show_id", "season").collect()
    assert [tuple(r) for r in n] == [("a", 1, 4), ("a", 2, 3), ("a", 3, 3), ("b", 1, 2), ("b", 2, 1)]
    assert "| a |" in tables.write_report(df, str(tmp_path / "r.json"))
    ok = spark.createDataFrame([("q", 5, "c", "up", None), ("", 5, "c", "up", 1), ("q", 11, "c", "no", 1)], "q string, k int, c string, v string, r int")
    assert [tuple(r) for r in ok.coalesce(1).select(tables.valid_request(ok.q, ok.k), tables.valid_feedback(ok.q, ok.c, ok.v, ok.r)).collect()] == [(True, True), (False, False), (False, False)]


def test_index(spark, tmp_path):
    rows = [(f"c{i}", "s" if i % 2 else "t", f"Line number {i} of word{i}", i * 1000) for i in range(20)]
    chunks = spark.createDataFrame(rows, "chunk_id string, show_id string, text_line string, start_ms long").withColumns({"text_embed": F.col("text_line"), "season": F.lit(1), "episode": F.col("start_ms").cast("int"), "show_title": F.lit(None).cast("string"), "end_ms": F.col("start_ms"), "context_before": F.array(F.lit("x")), "context_after": F.array(F.lit("y"))})
    built = index.build_index(chunks, HashedEmbedder(32))
    meta = index.save_index(built, str(tmp_path / "i"), "m")
    loaded, again = index.load_index(spark, str(tmp_path / "i"))
    assert meta == again and meta["embedding_dim"] == 32 and index.validate_index(loaded, 32) == []
    assert index.validate_index(loaded.drop("start_ms")) and index.validate_index(loaded.union(loaded), 31)
    assert index.describe_index(loaded).first()["count"] == 10
    with pytest.raises(ValueError, match="not unique"):
        index.merge_indexes([(loaded, meta), (loaded, meta)])
    with pytest.raises(ValueError, match="different models"):
        index.merge_indexes([(loaded, meta), (loaded, meta | {"embedding_dim": 3})])
    q = spark.createDataFrame([("q", "word7 of line number 7")], "query_id string, query string")
    top = search.formatted(search.search(q, loaded, HashedEmbedder(32), OverlapReranker())).orderBy("rank").collect()
    assert top[0].chunk_id == "c7" and [r.rank for r in top] == [1, 2, 3, 4, 5] and top[0].timestamp_start == "0:07"


def test_recall_gate_is_below_the_scorers(spark):
    """The reranker and the fuzzy match see what the rank filter lets through."""
    chunks = spark.createDataFrame([("c", "s", 1, 1, "x", "x", 0)], "chunk_id string, show_id string, season int, episode int, text_line string, text_embed string, start_ms long")
    plan = search.candidates(spark.createDataFrame([("q", "x")], "query_id string, query string"), index.build_index(chunks, HashedEmbedder(4)), HashedEmbedder(4), OverlapReranker())._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Window")


def test_expansion(spark):
    rows = [("q1", "danger zone", "exact"), ("q2", "MOTHER", "exact"), ("q3", "LANA", "exact"), ("q4", "none", "negative")]
    q = spark.createDataFrame(rows, "query_id string, query string, category string")
    memory = spark.createDataFrame([("q1", ["Danger  Zone", "anger zone", "the zone"])], "query_id string, variants array<string>")
    got = {(r.query_id, r.query, r.variant_type) for r in evaluate.expand_queries(q, memory).collect()}
    want = {(i, t, None) for i, t, _ in rows}
    want |= {("q1_m02", "anger zone", "memory"), ("q1_m03", "the zone", "memory")}
    want |= {(f"q1_a{k:02d}", v, "auto_typo") for k, v in enumerate(["anger zone", "adnger zone", "sanger zone", "eanger zone"], 1) if k > 1}
    want |= {(f"q2_a{k:02d}", v, "auto_typo") for k, v in enumerate(["OTHER", "OMTHER", "NOTHER", "JOTHER"], 1)}
    assert got == want


def test_evaluation(spark):
    q = spark.createDataFrame([("a", "exact", "s_S01E01", "Word"), ("b", "exact", "s_S01E02", None), ("n", "negative", None, None)], "query_id string, category string, expected_episode_id string, expected_cue_contains string")
    res = spark.createDataFrame([("a", 1, "t", 1, 1, "x"), ("a", 2, "s", 1, 1, "A WORD"), ("n", 1, "s", 1, 1, "x")], "query_id string, rank int, show_id string, season int, episode int, text_line string").withColumns({"score": F.lit(1.0), "start_ms": F.lit(0), "confidence": F.lit("high")})
    ranks = evaluate.hits(res, q)
    assert {(r.query_id, r.rank_episode, r.rank_cue) for r in ranks.collect()} == {("a", 2, 2), ("b", None, None), ("n", None, None)}
    assert {(r.query_id, r.rank_episode) for r in evaluate.hits(res, q, show="s").collect()} == {("a", 1), ("b", None), ("n", None)}
    r = evaluate.recall(ranks).first()
    assert (r.n, r.recall_at_1_episode, r.recall_at_5_cue, r.mrr_episode, r.objective) == (2, 0.0, 0.5, 0.25, 0.5)
    assert [m.query_id for m in evaluate.misses(ranks, res).collect()] == ["b"]
    assert len(evaluate.nested_results(res).filter("query_id = 'a'").first().top_results) == 2
    assert evaluate.calibration(res, ranks).first().n == 2
    assert evaluate.grid(spark, evaluate.QUICK_GRID).count() == 12 and evaluate.grid(spark, evaluate.FULL_GRID).count() == 648


def test_pages_and_filters(spark):
    html = "<a class='list-group-item' href='/versions-1-4-2-x-subtitles'></a><a class='list-group-item' href='/versions-9-4-2-y-subtitles'></a><a href='/versions-1-5-2-x-subtitles'></a>"
    got = pages.episode_links(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string"), "https://h.example").collect()
    assert [tuple(r) for r in got] == [(1, 2, 4, "https://h.example/versions-1-4-2-x-subtitles")]
    doc = json.dumps({"videos": {"1": {"seasonList": {"seasons": {"$type": "list", "values": [{"$type": "ref", "value": ["videos", "5"]}, {"id": 6}]}}}, "5": {"id": {"$type": "atom", "value": 5}, "episodes": {"0": {"$type": "ref", "value": ["videos", "50"]}, "10": {"id": 52}, "9": {"id": 51}}}, "6": {"episodes": [{"id": {"value": 60}}]}, "50": {"id": 50}}})
    assert sorted(map(tuple, pages.walk_graph(spark.createDataFrame([(doc,), (None,)], "document string"), "1").collect())) == [(1, 1, "50"), (1, 2, "51"), (1, 3, "52"), (2, 1, "60")]
    sql.register(spark)
    assert sorted(map(tuple, spark.sql("SELECT * FROM walk_graph('" + doc + "', '1')").collect())) == [(1, 1, "50"), (1, 2, "51"), (1, 3, "52"), (2, 1, "60")]
    films = spark.createDataFrame([(1999, ["drama"], "Ann Lee"), (2005, ["comedy"], "Bo")], "year int, genres array<string>, director string")
    assert relational.metadata_filter(films, 1990, 2000, "drama", "ann lee").count() == 1
    assert [r[0] for r in spark.createDataFrame([("the cat and the dog is here",), ("der die das und",), ("zzz",)], "x string").coalesce(1).select(detect_language("x")).collect()] == ["en", "de", None]


def test_graph_documents(spark):
    """References, atoms and lists in the shapes they may take, against rows written out by hand."""
    ref = lambda *path: {"$type": "ref", "value": list(path)}
    atom = lambda x: {"$type": "atom", "value": x}
    listed = lambda *x: {"$type": "list", "values": list(x)}
    cases = [
        (None, []), ("not json", []), ("{}", []), ("[1]", []),
        ({"videos": {"9": {"seasonList": {"seasons": [7]}}, "7": {"episodes": [ref("videos", "70"), 71, {"id": atom("x")}]}, "70": {"id": atom(70)}}}, [(1, 1, "70"), (1, 3, "x")]),
        ({"videos": {"9": {"seasonList": {"seasons": ref("lists", "s")}}, "70": {"id": 70}}, "lists": {"s": {"2": ref("lists", "t"), "11": {"id": 8, "episodes": listed({"id": atom(80)})}, "length": 2}, "t": {"id": atom(7), "episodes": {"1": ref("videos", "70"), "0": ref("videos", "none")}}}}, [(1, 2, "70"), (2, 1, "80")]),
        ({"videos": {"9": {"seasonList": {"seasons": listed({"name": "no id"}, ref("videos", "7"))}}, "7": {"id": atom(7), "episodes": ref("eps")}}, "eps": [{"id": {"value": "e"}}]}, [(2, 1, "e")]),
    ]
    for document, want in cases:
        text = document if document is None or isinstance(document, str) else json.dumps(document)
        got = pages.walk_graph(spark.createDataFrame([(text,)], "document string"), "9").collect()
        assert sorted(map(tuple, got)) == want, document


def test_no_values_have_a_row_of_zeros(spark):
    empty = spark.range(0).withColumnRenamed("id", "x")
    assert set(corpus.distribution(empty, "x").first()) == {0}
    assert corpus.distribution(empty.withColumn("k", F.lit(1)), "x", ["k"]).count() == 0


def test_wrappers_come_off(spark):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.srt", "zipped")
    rows = [(1, bytearray(b"plain")), (2, bytearray(gzip.compress(b"gzipped"))), (3, bytearray(packed.getvalue())), (4, None), (5, bytearray(b""))]
    got = {r.k: r.content and bytes(r.content) for r in subtitles.unwrapped(spark.createDataFrame(rows, "k int, content binary")).collect()}
    assert got == {1: b"plain", 2: b"gzipped", 3: b"zipped", 4: None, 5: bytearray(b"")}


def test_more_than_ninety_nine_variants(spark):
    q = spark.createDataFrame([("a", "exact", "q")], "query_id string, category string, query string")
    memory = spark.createDataFrame([("a", [f"variant number {i}" for i in range(120)])], "query_id string, variants array<string>")
    ids = [r.query_id for r in evaluate.expand_queries(q, memory, typos=False).collect()]
    assert len(ids) == len(set(ids)) == 121 and {"a", "a_m01", "a_m120"} <= set(ids)
