"""Sharding by size-tiered compaction, in DataFrame functions alone.

A store is a folder of immutable Parquet shards and of manifests ``_manifests/v00000001.json`` and on. A version
is the set of shards that its manifest lists; writing the manifest of the next number, which fails if another
writer took that number, is the commit. Arrivals are appended as small shards. Shards of similar size form a
tier; a tier with `fanout` shards or more is merged into files of the target size, and those are left alone.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.llm.common import shared_dir

TARGET_BYTES = 128 << 20
#: Shards of one tier that trigger a merge, and the size ratio between tiers.
FANOUT = 4
#: Files that one round of merges writes at most; further rounds do the rest.
MERGES = 256


@dataclass(frozen=True)
class Shard:
    """One immutable file: its path under the store, bytes and the version that added it."""

    path: str
    bytes: int
    added: int


class ShardStore:
    """Append, compact and read a store at `root`, any Hadoop path that all machines share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target_bytes, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests

    def version(self) -> int:
        """The newest committed version; 0 for a new store."""
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([0, *(int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, shards} of a version, the newest by default."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        rows = self.spark.read.text(f"{self.root}/_manifests/v{version:08d}.json", wholetext=True).collect()
        out = json.loads(rows[0].value)
        return out | {"shards": [Shard(**s) for s in out["shards"]]}

    def _commit(self, before: dict, schema: str, shards: list[Shard]) -> int:
        """Publish the version after `before`; raises if it exists, whoever wrote it."""
        version = before["version"] + 1
        target = self._path(f"{self.root}/_manifests/v{version:08d}.json")
        passing = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(passing, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        # A rename onto an existing name is refused by the context API, on every file system.
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(passing, target, none)
        except Exception as e:
            self._fs.delete(passing, False)
            raise FileExistsError(f"version {version} was committed by another writer") from e
        return version

    def _files(self, folder: str, version: int) -> list[Shard]:
        """Data files under a folder of the store, in name order."""
        found, listing = [], self._fs.listFiles(self._path(f"{self.root}/{folder}"), True)
        while listing.hasNext():
            f = listing.next()
            if f.getPath().getName().endswith(".parquet") and f.getLen():
                path = f.getPath().toString()
                found.append(Shard(path[path.index(f"/{folder}/") + 1 :], f.getLen(), version))
        return sorted(found, key=lambda s: s.path)

    # Writers

    def append(self, df: DataFrame, by: Column | None = None) -> int:
        """Write df as new shards and commit them as one version. `by` splits df into arrivals, a folder each."""
        before = self.manifest()
        schema = before["schema"] or df.schema.json()
        folder = f"data/{uuid.uuid4().hex}"
        if by is None:
            df.write.parquet(f"{self.root}/{folder}")
        else:
            df.withColumn("_arrival", by).write.partitionBy("_arrival").parquet(f"{self.root}/{folder}")
        return self._commit(before, schema, before["shards"] + self._files(folder, before["version"] + 1))

    def tier(self, size: int) -> int:
        """Tier of a shard: steps of `fanout` in size below the target, where tier 0 is half the target or more."""
        return max(0, math.ceil(math.log(max(1.0, self.target_bytes / 2 / max(1, size)), self.fanout)))

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups of shards to merge into one file of about the target size each.

        A full tier takes the smaller ones with it, since a merge passes over them anyway.
        """
        small = sorted((s for s in shards if self.tier(s.bytes) > 0), key=lambda s: (s.bytes, s.path))
        tiers: dict[int, int] = {}
        for s in small:
            tiers[self.tier(s.bytes)] = tiers.get(self.tier(s.bytes), 0) + 1
        full = [t for t, n in tiers.items() if n >= self.fanout]
        if not full:
            return []
        groups, total = [[]], 0
        for s in sorted((s for s in small if self.tier(s.bytes) >= min(full)), key=lambda s: s.path):
            if groups[-1] and total + s.bytes > self.target_bytes:
                groups.append([])
                total = 0
            groups[-1].append(s)
            total += s.bytes
        return [g for g in groups if len(g) > 1][:MERGES]

    def compact(self) -> int:
        """Merge full tiers until none is left; every round is one job and one committed version.

        A group's files are read in the splits of a single task and written as one file: no shuffle. Groups run
        as parts of one union, so that all executors work at once.
        """
        while groups := self.plan((before := self.manifest())["shards"]):
            schema = self.spark.createDataFrame([], "x int").schema.fromJson(json.loads(before["schema"]))
            folder = f"data/{uuid.uuid4().hex}"
            merged = None
            for g in groups:
                one = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in g]).coalesce(1)
                merged = one if merged is None else merged.union(one)
            merged.write.parquet(f"{self.root}/{folder}")
            gone = {s.path for g in groups for s in g}
            keep = [s for s in before["shards"] if s.path not in gone]
            self._commit(before, before["schema"], keep + self._files(folder, before["version"] + 1))
        return self.version()

    def vacuum(self) -> int:
        """Delete data files that the newest version doesn't list; returns how many. Run it when no reader holds an older one."""
        listed = {s.path for s in self.manifest()["shards"]}
        gone = [s for s in self._files("data", 0) if s.path not in listed]
        for s in gone:
            self._fs.delete(self._path(f"{self.root}/{s.path}"), False)
        return len(gone)

    # Readers

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version."""
        m = self.manifest(version)
        if not m["schema"]:
            raise FileNotFoundError(f"{self.root} has no version")
        schema = self.spark.createDataFrame([], "x int").schema.fromJson(json.loads(m["schema"]))
        if not m["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in m["shards"]])


def sharded(docs: DataFrame, arrivals: int = 8, target_bytes: int = TARGET_BYTES, root: str | None = None) -> ShardStore:
    """A compacted store of docs that came in `arrivals` lots (by hash of doc_id, a null id in the first).

    Rows are kept as they are: nulls, empty and very long texts, repeated rows, and any further columns but
    _arrival. An empty table makes a store with no shards.
    """
    store = ShardStore(docs.sparkSession, root or shared_dir(docs.sparkSession, "shards"), target_bytes)
    store.append(docs, F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)), F.lit(0)))
    store.compact()
    store.vacuum()
    return store


def shard_report(store: ShardStore) -> DataFrame:
    """Per row of the newest version: doc_id, shard (file name), version, and the text's crc32, read back from the shards."""
    rows = store.read()
    shard = F.col("_metadata.file_name") if store.manifest()["shards"] else F.lit("")
    return rows.select("doc_id", shard.alias("shard"), F.lit(store.version()).alias("version"), F.crc32("text").alias("text_crc32"))
