import pytest

from cuelight.llm.common import shared_dir
from cuelight.llm.shard_store import ShardStore, shard_report, sharded

SCHEMA = "doc_id long, text string, shard string, version long"


def test_whole_table(spark):
    rows = [(i if i % 9 else None, None if i % 7 == 0 else f"text {i} " * (i % 50), "clash", 1) for i in range(2000)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    store = sharded(df, target_bytes=30_000)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, store.read().collect()), key=key) == sorted(rows, key=key)
    first, last = store.manifest(1)["shards"], store.manifest()["shards"]
    assert len(last) < len(first) and not store.plan(last) and shard_report(store).count() == len(rows)
    assert store.vacuum() == 0


def test_appends_and_versions(spark):
    store = ShardStore(spark, shared_dir(spark, "store"), target_bytes=1 << 20)
    for k in range(5):
        store.append(spark.createDataFrame([(k, "t", "s", k)], SCHEMA).coalesce(1))
    assert store.version() == 5 and len(store.manifest()["shards"]) == 5
    assert store.compact() == 6 and len(store.manifest()["shards"]) == 1
    assert store.read(3).count() == 3 and store.read().count() == 5
    with pytest.raises(FileExistsError):
        store._commit(store.manifest(4), store.manifest()["schema"], [])
    assert store.vacuum() == 5


def test_empty(spark):
    store = sharded(spark.createDataFrame([], SCHEMA))
    assert store.read().count() == 0 and store.manifest()["shards"] == [] and shard_report(store).count() == 0
