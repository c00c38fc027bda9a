"""Mixing sources to target weights by a low-discrepancy source schedule.

Slot i of the schedule has the point frac((i + 1) * golden ratio); the source whose interval of cumulative
target weights holds the point owns the slot. A source's slots, ranked, take its blocks of equal word count in
turn. Blocks are cut from the source's documents in hash order and are taken again from the first one when all
are used, until the source's target is reached; the last slot of a source takes a part of its block.

A source's blocks are equal, but a small source has smaller ones. Its interval is its share of all slots, so that
every part of the schedule holds the same share of each source's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.llm.common import WORD, written

#: Words in a source's block at most, and blocks that a source's target has at least, so that small ones mix evenly too.
BLOCK_WORDS, LEAST_BLOCKS = 512, 200
#: Documents, or slots, that one task orders at a time.
BUCKET_ROWS = 8192
#: No document is taken more often.
MAX_REPEATS = 3


def n_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of sizes(source, source_size): they share the sum by the weights 1, 2, 3, repeating.

    Sources are in code point order, null last. A target stops at `repeats` times its source's size and the
    excess goes to the others by weight until none is above. In the order of repeats * size / weight the
    stopped sources are a prefix, so that one pass over running sums settles all rounds at once.
    One row per source is ordered in one task; sources are few beside documents.
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(repeats))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    ranked = ranked.withColumns({
        "level": (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    })
    ranked = ranked.withColumn("place", F.row_number().over(by))
    first_free = F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.col("place"))
    ranked = ranked.withColumn("rest", F.min_by("level", first_free).over(everything))
    ranked = ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("rest")))
    return ranked.select("source", "source_size", "weight", F.coalesce("target", F.lit(0.0)).alias("target"))


def running_start(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, size: Column, name: str) -> DataFrame:
    """df with `name`: the sum of `size` over the rows of the same keys that come before, in order of (bucket, order).

    Buckets split a key's rows over tasks: sums within a bucket, plus the prefix sums of the buckets' totals.
    """
    df = df.withColumn("_bucket", bucket).withColumn("_size", size)
    totals = df.groupBy(*keys, "_bucket").agg(F.sum("_size").alias("_total"))
    own = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(own), F.lit(0)).alias("_base"))
    here = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_inner", F.coalesce(F.sum("_size").over(here), F.lit(0)))
    same = [inner[k].eqNullSafe(bases[k]) for k in (*keys, "_bucket")]
    joined = inner.join(bases, on=same, how="inner").select(*(inner[c] for c in inner.columns if c != "_size"), bases["_base"])
    return joined.withColumn(name, F.col("_base") + F.col("_inner")).drop("_bucket", "_inner", "_base")


def mixed_schedule(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sizes per row, targets per source, slots of the schedule and pieces of documents, for docs(doc_id, text, source).

    Sizes: (doc_id, source, size, _text, _key), the last two hashes of text and id. Targets: (sid, source, source_size, weight, target, words, block, n). Slots: (slot,
    sid, rank, n_words, block_id), in training order. Pieces: (sid, block, block_id, doc_id, size, _text, at, begin, end),
    the words of a document that a block holds; `at` is the document's first word in its source.
    Null texts and texts without words have size 0 and are in no block. Rows that share a doc_id are documents
    of their own. Other columns of docs are ignored. An empty table has no sources and no slots.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    sized = written(sized.withColumn("_key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")), "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    head = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    targets = targets.withColumn("sid", head).withColumn("words", F.round("target").cast("long"))
    targets = targets.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("target") / LEAST_BLOCKS))).cast("long"))
    turns, rest = F.floor(F.col("words") / F.greatest(F.lit(1), F.col("source_size"))), F.col("words") % F.greatest(F.lit(1), F.col("source_size"))
    targets = written(targets.withColumn("n", (turns * F.ceil(F.col("source_size") / F.col("block")) + F.ceil(rest / F.col("block"))).cast("long")), "mix-targets")
    seen = targets.agg(F.sum("n").alias("slots"), F.count("*").alias("n")).first()
    if not seen.slots:
        slots = spark.createDataFrame([], "slot long, sid int, rank long, n_words long, block_id long")
        return sized, targets, slots, spark.createDataFrame([], "sid int, block long, block_id long, doc_id long, size long, _text long, at long, begin long, end long")
    n_sources, n_docs = seen.n, sized.count()

    # Documents in hash order, end to end within their source, cut into blocks.
    n_buckets = max(1, -(-n_docs // BUCKET_ROWS))
    placed = sized.join(targets.select("source", "sid", "block"), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    placed = running_start(placed.filter("size > 0"), ["sid"], [F.col("_key"), F.col("doc_id"), F.col("_text")], F.shiftright(F.shiftright("_key", 30) * n_buckets, 30), F.col("size"), "at")
    block = F.col("block")
    pieces = placed.select("sid", "block", "doc_id", "size", "_text", "at", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block_id"))
    into = F.col("at") - F.col("block_id") * block
    pieces = pieces.select("sid", "block", "block_id", "doc_id", "size", "_text", "at", F.greatest(into, F.lit(0)).alias("begin"), F.least(into + F.col("size"), block).alias("end"))

    # Slots: rather more than needed, as a source's share of a low-discrepancy sequence is off by a few slots.
    by = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    bounds = targets.filter("n > 0").select("*", (F.coalesce(F.sum("n").over(by), F.lit(0)) / F.lit(seen.slots)).alias("low"))
    bounds = bounds.withColumn("high", F.col("low") + F.col("n") / F.lit(seen.slots))
    cells = max(64, 2 * n_sources)
    spread = bounds.select("sid", "low", "high", "words", "source_size", "block", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))).alias("cell"))
    n_slots = int(seen.slots * 1.02) + 40 * n_sources + 64
    golden = (F.col("slot").cast("decimal(20,0)") + 1) * F.lit("0.618033988749894848").cast("decimal(18,18)")
    point = (golden - F.floor(golden)).cast("double")
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.floor(F.col("point") * cells))
    slots = slots.join(spread, "cell").filter("point >= low AND point < high")
    slots = running_start(slots.select("slot", "sid", "words", "source_size", "block"), ["sid"], [F.col("slot")], F.floor(F.col("slot") / BUCKET_ROWS), F.lit(1), "rank")
    n_blocks = F.ceil(F.col("source_size") / block)
    turn = F.floor(F.col("rank") / n_blocks)
    inner = F.col("rank") % n_blocks
    used = turn * F.col("source_size") + inner * block
    length = F.least(block, F.col("source_size") - inner * block, F.col("words") - used)
    slots = slots.select("slot", "sid", "rank", length.cast("long").alias("n_words"), inner.cast("long").alias("block_id")).filter("n_words > 0")
    return sized, targets, slots, pieces


def _taken(docs: DataFrame, block_words: int, seed: int) -> DataFrame:
    """Per row of docs: doc_id, _text, size, source_size, target and taken."""
    sized, targets, slots, pieces = mixed_schedule(docs, block_words, seed)
    # The slots of a block differ in n_words only at a source's end: pre-aggregate by (source, block, length).
    uses = slots.groupBy("sid", "block_id", "n_words").agg(F.count("*").alias("uses"))
    held = F.greatest(F.lit(0), F.least(F.col("end"), F.col("n_words")) - F.col("begin")) * F.col("uses")
    taken = pieces.join(uses, ["sid", "block_id"], "left").groupBy("sid", "at", "doc_id", "_text", "size").agg(F.coalesce(F.sum(held), F.lit(0)).cast("long").alias("taken"))
    known = targets.select("sid", "source_size", "target")
    out = ["doc_id", "_text", "size", "source_size", "target", "taken"]
    none = sized.filter("size = 0").join(targets, sized["source"].eqNullSafe(targets["source"])).withColumn("taken", F.lit(0).cast("long"))
    return taken.join(known, "sid").select(out).unionByName(none.select(out))


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target (its source's) and taken, the words that the mix takes.

    Each source's taken words are its target rounded; no document is taken more than three times over.
    See mixed_schedule() for nulls, ties and empty tables.
    """
    return _taken(docs, block_words, seed).drop("_text")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """docs as the mix takes them, in the schedule's order: each row once for each slot that takes its first word.

    Rows lie in the order of their slots, range by range, so that files written from them do too. A row is taken
    whole, three times at most, so that a source's words are its target but for its last document. Rows taken not at
    all go, as do rows without words, null texts among them. Rows that are equal in doc_id and text share their copies
    evenly, rounded up. Null doc_ids are ids like others; extra columns may have any name; an empty table stays so.
    """
    _, _, slots, pieces = mixed_schedule(docs, block_words, seed)
    first = pieces.filter(F.col("at") >= F.col("block_id") * F.col("block")).withColumnRenamed("begin", "into")
    taken = first.join(slots.select("slot", "sid", "block_id", "n_words"), ["sid", "block_id"]).filter("into < n_words")
    own = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.isnull("doc_id").alias("_none"), F.col("_text")]
    once = taken.groupBy("sid", "at", *own).agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.sum("slot").alias("sum"))
    share = F.ceil(F.sum("n") / F.count("*")).cast("int")
    middle = F.when(F.count("*") > 1, F.floor((F.min("low") + F.max("high")) / 2)).otherwise(F.max(F.col("sum") - F.col("low") - F.col("high")))
    at = F.when(share == 1, F.array(F.min("low"))).when(share == 2, F.array(F.min("low"), F.max("high"))).otherwise(F.array(F.min("low"), middle, F.max("high")))
    copies = once.groupBy("_id", "_none", "_text").agg(at.alias("_slots"))
    # One struct holds the row, so that no column of docs can clash with those of the join.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.isnull("doc_id").alias("_none"), F.xxhash64("text").alias("_text"))
    placed = rows.join(copies, ["_id", "_none", "_text"]).select("_row", F.explode("_slots").alias("_slot"), "_id", "_text")
    return placed.repartitionByRange("_slot", "_id", "_text").sortWithinPartitions("_slot", "_id", "_text").select("_row.*")


#: DuckDB: a source's stream of words, in hash order and repeated, is taken up to its target.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0'), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, row_number() OVER w AS place, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM r WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST), b AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * (SELECT arg_min(level, place) FROM l WHERE 3 * source_size >= weight * level)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS words, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size + greatest(0, least(size, words % source_size - begin)) END AS BIGINT) AS taken FROM p
"""
