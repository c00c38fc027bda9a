from pyspark.sql import functions as F

from cuelight import api
from cuelight.models import HashedEmbedder


def srt(n, word):
    return "\n\n".join(f"{i}\n00:{i // 60:02d}:{i % 60:02d},000 --> 00:{i // 60:02d}:{i % 60:02d},900\nLine {i} about {word}{i}" for i in range(1, n + 1))


def test_ingest_index_evaluate(spark, tmp_path):
    for name, n in (("Talk.S01E01.WEB.srt", 60), ("Talk.S02E01.WEB.srt", 55), ("Talk.S01E02.WEB.srt", 3)):
        path = tmp_path / "subs/talk" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(srt(n, "apple" if "E01" in name and "S01" in name else "pear"))
    titles = spark.createDataFrame([("talk", "Talk")], "show_id string, show_title string")
    made = api.ingest(spark, str(tmp_path / "subs"), str(tmp_path / "out"), titles=titles)
    assert {(r.season, r.episode): r.status for r in made["audit"].collect()} == {(1, 1): "valid_srt", (2, 1): "valid_srt", (1, 2): "low_cue_count"}
    assert made["cues"].count() == made["chunks"].count() == 115
    assert [(r.season, r.episode, r.chunk_count, r.verified) for r in made["manifest"].orderBy("season").collect()] == [(1, 1, 60, "True"), (2, 1, 55, "True")]
    new = made["cues"].filter("season = 2").limit(2).withColumn("text_clean", F.lit("patched"))
    cues, chunks = api.ingest_changed(made["cues"], made["chunks"], new)
    assert cues.count() == chunks.count() == 62
    meta = api.build(made["chunks"], str(tmp_path / "index"), HashedEmbedder(64), season=1)
    assert meta["chunk_count"] == 60
    q = spark.createDataFrame([("q1", "line 30 about apple30", "talk_S01E01", 1, "apple30", "exact"), ("q2", "nothing", None, None, None, "negative")], "query_id string, query string, expected_episode_id string, expected_season int, expected_cue_contains string, category string")
    chunks = spark.read.parquet(str(tmp_path / "index/chunks"))
    out = api.evaluate_queries(q, chunks, HashedEmbedder(64), season=1)
    first = out["recall"].first()
    assert first.n == 1 and first.recall_at_1_episode == 1.0 and out["negatives"].count() <= 5
    requests = q.select("query_id", "query", F.lit(5).alias("top_k")).union(spark.createDataFrame([("q3", "", 5)], "query_id string, query string, top_k int"))
    log, bad = api.request_log(requests, out["results"])
    assert log.count() == 2 and bad.count() == 1 and all(len(r.top_chunk_ids) <= 3 for r in log.collect())
    assert api.take(out["results"], 1).count() == out["results"].select("query_id").distinct().count()
