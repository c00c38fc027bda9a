import json

from pyspark.sql import functions as F

from cuelight.streaming import events as stream


def test_log_to_sink_and_tally(spark, tmp_path):
    rows = [{"ts": "2024-01-01T00:00:00+00:00", "type": "query", "query": "q", "latency_ms": 10, "result_count": 0}, *({"ts": f"2024-01-01T00:0{k}:00+00:00", "type": "feedback", "chunk_id": "c", "vote": v} for k, v in enumerate(["up", "up", "down"]))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    live = stream.read_events(spark, str(tmp_path / "in"))
    job = stream.to_sink(stream.forwarded(live), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination()
    out = spark.read.json(str(tmp_path / "out"))
    assert out.count() == 3 and "query" in out.columns
    job = stream.vote_tally(live).writeStream.outputMode("complete").format("memory").queryName("tally").trigger(availableNow=True).start()
    job.awaitTermination()
    assert tuple(spark.table("tally").first()) == ("c", 2, 1, 1)
    static = spark.read.schema(live.schema).json(str(tmp_path / "in"))
    assert stream.query_stats(static).first().empty == 1
    job = stream.once(live, "event_time", ["chunk_id"], "1 hour").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    job.awaitTermination()
    assert spark.table("once").filter(F.col("chunk_id") == "c").count() == 1


def test_patch_batches(spark, tmp_path):
    base = str(tmp_path / "base")
    spark.createDataFrame([(1, 1, "a"), (1, None, "b")], "season int, episode int, text string").write.parquet(f"{base}/v0")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/p.json").write_text(json.dumps({"season": 1, "text": "new"}))
    live = spark.readStream.schema("season int, episode int, text string").json(str(tmp_path / "in"))
    job = live.writeStream.foreachBatch(stream.patcher(spark, base, ["season", "episode"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{base}/v1").collect()} == {(1, 1, "a"), (1, None, "new")}
