"""N-gram Jaccard join: a size-aware heavy-light join on shingle sets, exact at its threshold.

Equal sets are one class; classes are joined. All sets share one order of shingles, and of a set of n shingles only
a prefix of about (1 - threshold) * n can matter: linked sets share a shingle of their prefixes, and two if the
prefixes are one longer. Small sets enumerate the 2-subsets of their prefixes and meet in equal subsets. Large sets
scan the inverted lists of their prefixes' shingles. The boundary in size is where the sum of both costs is least.

Shingles in many sets (heavy ones) come last in the order, so that passages which many documents share don't lead
their prefixes. Sets that still have heavy shingles there are ordered once more among themselves, by all of their
shingles rather than a share; those that share heavy ones even then, such as families of near copies, go to a common
cluster. Without that, passages would chain unlike sets to clusters that grow with the table, and blocks with its square.
Candidates from lists are pruned by what their prefixes can still reach. The clusters that candidates form are
verified with whole sets as blocks of a matrix product, and only what connects them is returned: no task holds an
unbounded group and no pairs are listed within one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelight.llm.common import chunks, lean, lower_ascii, mix, modest_batches, not_space, prefix_hash, span_hash, split_by_sketch, text_bytes, word_spans, written
from cuelight.llm.components import components

SHINGLE, PERCENT = 4, 85
#: Shingles in more classes than this are heavy, as far as so many can be told to all workers; the rest are found in
#: the lists themselves, which list pairs up to LIST_MAX sets and make a cluster of longer ones.
HEAVY_FROM, HEAVY_MAX, LIST_MAX = 16, 1 << 17, 48
#: The order begins with shingles whose hash is below this share of all; these are counted to find heavy ones.
LOW_SHARE = 4
#: A block of a cluster's matrix product: sets and shingles.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1_500_000

_LOWER, _WORD = lower_ascii(), not_space()
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 64) // LOW_SHARE)
_ALL = np.uint64((1 << 64) - 1)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of `size` words, or all words of a shorter text."""
    raw, at = text_bytes(column)
    low = _LOWER[raw]
    starts, ends, first = word_spans(low, at, _WORD)
    words = span_hash(prefix_hash(low), starts, ends)
    n = len(words)
    grams = np.zeros(0, np.uint64)
    if n >= size:
        grams = words[: n - size + 1].copy()
        for k in range(1, size):
            grams = grams * _STEP + words[k : n - size + 1 + k]
        grams = mix(grams)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            short = np.uint64(b - a)
            for w in words[a:b]:
                short = np.uint64((int(short) * int(_STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            yield mix(np.array([short]))
        else:
            yield np.zeros(0, np.uint64)


def prefix_size(n, percent: int):
    """Length of the prefix of a set of n shingles in which it shares one with any linked set."""
    return n - (-(-percent * n // 100)) + 1


def _signature(s: np.ndarray) -> tuple[int, int]:
    m = mix(s)
    total = m.sum(dtype=np.uint64) if len(s) else np.uint64(0)
    other = np.bitwise_xor.reduce(mix(m + np.uint64(len(s)))) if len(s) else np.uint64(0)
    return int(np.int64(total.view(np.int64))), int(np.int64(np.uint64(other).view(np.int64)))


def _sets(size: int, percent: int) -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            n, h1, h2, low = [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                keep = max(int(np.searchsorted(s, _LOW)), min(len(s), prefix_size(len(s), percent) + 1))
                a, b = _signature(s)
                n.append(len(s))
                h1.append(a)
                h2.append(b)
                low.append(s[:keep].tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()), "h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "low": pa.array(low, pa.binary())})

    return lean(build)


def _token_counts(bound: np.uint64) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint64)
            there, times = np.unique(tokens[tokens < bound], return_counts=True)
            for k in range(0, len(there), 1 << 18):
                yield pa.RecordBatch.from_pydict({"token": pa.array(there[k : k + (1 << 18)].view(np.int64)), "c": pa.array(times[k : k + (1 << 18)].astype(np.int64))})

    return lean(count)


def _ordered(low: bytes, heavy: np.ndarray, place: np.ndarray, bound: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of a set in the common order: light ones below the bound, heavy ones by `place`, the others; which are
    heavy; and the place of each in the order."""
    s = np.frombuffer(low, np.uint64)
    at = (s >> np.uint64(3)).astype(np.int64) + np.where(s >= bound, np.int64(2 << 61), np.int64(0))
    is_heavy = np.zeros(len(s), bool)
    if len(heavy):
        near = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
        is_heavy = heavy[near] == s
        at[is_heavy] = (1 << 61) + place[near[is_heavy]]
    order = np.argsort(at, kind="stable")
    return s[order], is_heavy[order], at[order]


def _emitter(shared, percent: int, boundary: int, heavies: bool, bound: np.uint64) -> Callable:
    """Signatures of each set: (sig, uid, n, hv, last, kind); with `heavies` those of heavy shingles alone.

    kind 1 is a single shingle and 2 a subset. hv is how many shingles of the prefix are heavy, last the place of
    the prefix's last shingle in the order.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, place = shared.value
        subsets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for uid, n, low in zip(batch.column("uid").to_pylist(), batch.column("n").to_pylist(), batch.column("low").to_pylist(), strict=True):
                if 100 * n < percent * (n + 1):  # only equal sets are linked with so small a one
                    continue
                s, is_heavy, order = _ordered(low, heavy, place, bound)
                p = prefix_size(n, percent)
                if heavies:
                    sig = s[: p + 1][is_heavy[: p + 1]] if n <= boundary else s[:p][is_heavy[:p]]
                    if len(sig):
                        out[0].append(sig)
                        out[1].append(np.full(len(sig), uid))
                    continue
                sigs, kinds = [], []
                if 100 * n > percent * boundary:
                    light = s[:p][~is_heavy[:p]]
                    sigs.append(light)
                    kinds.append(np.ones(len(light), np.int8))
                if n <= boundary:
                    if p not in subsets:
                        subsets[p] = np.triu_indices(p + 1, 1)
                    i, j = subsets[p]
                    both = ~is_heavy[i] & ~is_heavy[j] if is_heavy[: p + 1].any() else slice(None)
                    i, j = i[both], j[both]
                    sigs.append(mix(s[i] * _STEP + s[j]))
                    kinds.append(np.full(len(i), 2, np.int8))
                sig = np.concatenate(sigs)
                if not len(sig):
                    continue
                out[0].append(sig)
                out[1].append(np.full(len(sig), uid))
                out[2].append(np.full(len(sig), n))
                out[3].append(np.full(len(sig), int(is_heavy[:p].sum())))
                out[4].append(np.full(len(sig), order[p - 1]))
                out[5].append(np.concatenate(kinds))
            if out[0]:
                table = {"sig": pa.array(np.concatenate(out[0]).view(np.int64)), "uid": pa.array(np.concatenate(out[1]), pa.int64())}
                if not heavies:
                    table |= {"n": pa.array(np.concatenate(out[2]), pa.int32()), "hv": pa.array(np.concatenate(out[3]), pa.int32()), "last": pa.array(np.concatenate(out[4]), pa.int64()), "kind": pa.array(np.concatenate(out[5]), pa.int8())}
                yield pa.RecordBatch.from_pydict(table)

    return lean(emit)


#: Rows of lists: a candidate pair, or (hub) a set of a list that is too long to pair.
_PAIRS = "a long, b long, na int, nb int, hv int, side int, c int, hub boolean"


def _lists(percent: int, list_max: int) -> Callable:
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        sig, uid, n, hv, last, kind = (table.column(c).to_numpy() for c in ("sig", "uid", "n", "hv", "last", "kind"))
        order = np.lexsort((uid, kind, sig))
        same = (sig[order][1:] == sig[order][:-1]) & (kind[order][1:] == kind[order][:-1])
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        count = np.diff(np.append(begin, len(order)))
        for g in np.unique(count[count > 1]).tolist():
            at = begin[count == g]
            if g > list_max:
                for x in at.tolist():
                    rows = order[x : x + g]
                    zero = np.zeros(g, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(uid[rows], pa.int64()), pa.array(np.full(g, sig[rows[0]])), *[pa.array(zero, pa.int32())] * 5, pa.array(np.ones(g, bool))], schema=_SCHEMA)
                continue
            i, j = np.triu_indices(g, 1)
            per = max(1, (1 << 18) // len(i))
            for k in range(0, len(at), per):
                a = order[(at[k : k + per, None] + i).ravel()]
                b = order[(at[k : k + per, None] + j).ravel()]
                fit = (100 * np.minimum(n[a], n[b]).astype(np.int64) >= percent * np.maximum(n[a], n[b]).astype(np.int64)) & (uid[a] != uid[b])
                a, b = a[fit], b[fit]
                if not len(a):
                    continue
                # Beyond the smaller last shingle, its set has so many shingles left; on a tie either may.
                left = lambda x: n[x].astype(np.int64) - prefix_size(n[x].astype(np.int64), percent)
                side = np.where(last[a] < last[b], left(a), np.where(last[a] > last[b], left(b), np.maximum(left(a), left(b))))
                c = np.where(kind[a] == 2, 1 << 20, 1)
                cols = [pa.array(uid[a]), pa.array(uid[b]), pa.array(n[a], pa.int32()), pa.array(n[b], pa.int32()), pa.array(np.minimum(hv[a], hv[b]), pa.int32()), pa.array(side, pa.int32()), pa.array(c, pa.int32()), pa.array(np.zeros(len(a), bool))]
                yield pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)

    return lean(pair)


_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("hv", pa.int32()), ("side", pa.int32()), ("c", pa.int32()), ("hub", pa.bool_())])


def choose_boundary(sizes: dict[int, int], extra: float, percent: int) -> int:
    """Largest size of a small set: where signatures of small sets and list entries of large ones cost least in all.

    `sizes` counts sets by size as far as a boundary may lie; `extra` is how many other sets a list entry meets.
    """
    p = {n: prefix_size(n, percent) for n in sizes}
    cost = {}
    for b in [0, *sorted(sizes)]:
        small = sum(k * p[n] * (p[n] + 1) / 2 for n, k in sizes.items() if n <= b)
        cost[b] = small + sum(k * p[n] * (1 + extra) for n, k in sizes.items() if 100 * n > percent * b)
    return min(cost, key=lambda b: (cost[b], b))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of every left and right set; of left sets with each other if right is None."""
    sets = left + (right or [])
    flat = np.concatenate(sets)
    order = np.argsort(flat)
    of = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order]
    flat = flat[order]
    del order
    same = flat[1:] == flat[:-1]
    del flat
    new, shared = np.ones(len(of), bool), np.zeros(len(of), bool)
    new[1:] = ~same
    shared[1:] = same
    shared[:-1] |= same
    of, column = of[shared], np.cumsum(new[shared], dtype=np.int32) - 1
    del same, new, shared
    width = max(256, min(8192, (4 << 20) // max(1, len(sets))))
    m = len(left)
    total = np.zeros((m, m if right is None else len(right)), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [k, k + width])
        part = np.zeros((len(sets), width), np.float32)
        part[of[a:b], column[a:b] - k] = 1
        total += part[:m] @ (part.T if right is None else part[m:].T)
    return total


def _verifier(percent: int) -> Callable:
    """(a, b, k) for each set with a link in a block: its group's smallest set in the block, and its links there."""

    def group(rows: list[tuple[int, int, bytes]]) -> tuple[list[int], list[int], list[int]]:
        rows = list({uid: (uid, side, s) for uid, side, s in rows}.values())
        rows.sort(key=lambda r: (r[1], r[0]))
        sets = [np.frombuffer(s, np.uint64) for _, _, s in rows]
        m = sum(1 for r in rows if r[1] == 0)
        split = m if 0 < m < len(rows) else len(rows)
        both = split < len(rows)
        over = _overlaps(sets[:split], sets[split:] if both else None)
        n = np.array([len(s) for s in sets])
        rest = n[split:] if both else n
        link = np.zeros(over.shape, bool)
        for k in range(0, split, 256):  # whole matrices of long integers would be large
            link[k : k + 256] = (100 + percent) * over[k : k + 256].astype(np.int64) >= percent * (n[k : min(k + 256, split), None] + rest[None, :])
        if not both:
            np.fill_diagonal(link, False)
        count = np.concatenate([link.sum(1), link.sum(0)]) if both else link.sum(1)
        root = np.arange(len(rows))
        seen = count == 0
        for i in range(len(rows)):
            if seen[i]:
                continue
            reach = np.zeros(len(rows), bool)
            reach[i], new = True, np.array([i])
            while len(new):
                if both:
                    hit = np.concatenate([link[:, new[new >= split] - split].any(1), link[new[new < split]].any(0)])
                else:
                    hit = link[new].any(0)
                new = np.flatnonzero(hit & ~reach)
                reach[new] = True
            root[reach] = i
            seen |= reach
        least: dict[int, int] = {}
        for i in np.flatnonzero(count).tolist():
            least[root[i]] = min(least.get(root[i], rows[i][0]), rows[i][0])
        at = np.flatnonzero(count).tolist()
        return [rows[i][0] for i in at], [least[root[i]] for i in at], [int(count[i]) for i in at]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], ([], [], [])

        def close() -> None:
            if len(rows) > 1:
                for x, y in zip(out, group(rows), strict=True):
                    x.extend(y)

        for batch in batches:
            for k, uid, side, s in zip(*(batch.column(c).to_pylist() for c in ("key", "uid", "side", "tokens")), strict=True):
                if k != key:
                    close()
                    key, rows = k, []
                rows.append((uid, side, s))
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "k"])
                out = ([], [], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "k"])

    return lean(verify)


def _full_sets(size: int, keep: tuple[str, ...]) -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 20):
            tokens = []
            for s, a, b in zip(shingle_sets(batch.column("text"), size), batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True):
                tokens.append(s.tobytes() if _signature(s) == (a, b) else None)  # another text of the same doc_id
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"tokens": pa.array(tokens, pa.binary())})

    return lean(build)


def _candidates(classes: DataFrame, percent: int, whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) that put every two linked classes(uid, n, low) into one component; whole(uids) has (uid, n, low) of
    those classes with all their shingles.

    A linked pair that no list tells shares a heavy shingle, so that both are looked at again among such sets.
    """
    sizes = {r.n: r["count"] for r in classes.filter("n <= 400").groupBy("n").count().collect()}
    pairs, hubs = _listed(classes, percent, sizes, _LOW)
    again, hubs = _listed(written(whole(hubs.select("uid").distinct()), "hub-sets"), percent, {}, _ALL)
    first = hubs.groupBy("sig").agg(F.min("uid").alias("b"))
    return pairs.unionByName(again).unionByName(hubs.join(first, "sig").select(F.col("uid").alias("a"), "b").distinct())


def _listed(classes: DataFrame, percent: int, sizes: dict[int, int], bound: np.uint64) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of light shingles, and (sig, uid) of the sets in long lists or with heavy ones in front.

    Shingles below `bound` are counted, and `low` holds all of a set's that are; sizes are as choose_boundary() has it.
    """
    spark = classes.sparkSession
    counts = classes.select("low").mapInArrow(_token_counts(bound), "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    counts = written(counts.filter("c > 1"), "shingle-counts")
    heavy = [r.token for r in counts.filter(F.col("c") > HEAVY_FROM).orderBy(F.desc("c"), "token").limit(HEAVY_MAX).collect()]
    meets = counts.filter(F.col("c") <= HEAVY_FROM).agg(F.sum(F.col("c") * (F.col("c") - 1)), F.lit(1)).first()[0] or 0
    total = classes.agg(F.sum("n")).first()[0] or 0
    boundary = choose_boundary(sizes, meets / max(1.0, total / LOW_SHARE), percent)
    # Of heavy shingles the rarest comes first: it tells most.
    tokens = np.array(heavy[::-1], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    shared = spark.sparkContext.broadcast((tokens[order], order))
    source = classes.select("uid", "n", "low")
    rows = source.mapInArrow(_emitter(shared, percent, boundary, False, bound), "sig long, uid long, n int, hv int, last long, kind byte")
    lists = written(rows.repartition("sig").mapInArrow(_lists(percent, LIST_MAX), _PAIRS), "candidate-pairs")
    pairs = lists.filter("NOT hub").groupBy("a", "b").agg(F.sum(F.col("c").cast("long")).alias("c"), *[F.first(x).alias(x) for x in ("na", "nb", "hv", "side")])
    # What the rest of the smaller prefix's set may add, and heavy shingles, which no list has counted.
    pairs = pairs.filter((100 + percent) * (F.col("c") + F.col("hv") + F.col("side")) >= percent * (F.col("na") + F.col("nb")))
    hubs = source.mapInArrow(_emitter(shared, percent, boundary, True, bound), "sig long, uid long").unionByName(lists.filter("hub").select(F.col("b").alias("sig"), F.col("a").alias("uid")))
    return pairs.select("a", "b"), written(hubs, "heavy-sets")


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id and n_links.

    A set is the distinct runs of `size` words of the text, A-Z in lower case; a shorter text is one run; a text
    without words, or null, has an empty set and no link. Two rows link if 100 * |intersection| >= percent *
    |union|. component_id is the smallest doc_id within reach; n_links counts other texts' sets, where equal sets
    count once, that link with the row's. Rows that share a doc_id are rows of their own; a row with a null doc_id
    links with nothing and has a null component_id. Other columns are ignored. Shingles are compared by 64-bit
    hashes.
    """
    return _labelled(docs, size, percent).select("doc_id", "n_shingles", "component_id", "n_links")


def _labelled(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """jaccard_components() with the set's signature (h1, h2), and `first`: whether the row's doc_id and signature are
    the smallest of its component, or it has no component."""
    modest_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(rows.mapInArrow(_sets(size, percent), "doc_id long, n long, h1 long, h2 long, low binary").withColumn("uid", F.monotonically_increasing_id()), "shingle-sets")
    known = sets.filter("n > 0 AND doc_id IS NOT NULL")
    groups = written(known.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "uid")).alias("r")).select("h1", "h2", "r.doc_id", "r.uid"), "shingle-classes")
    # Nearly all rows stand for their class: only those that may not are shuffled to find out.
    others = written(known.select("uid").join(groups.select("uid"), "uid", "left_anti"), "other-rows")
    maybe, first = split_by_sketch(known.select("uid", "n", "low"), "uid", others)
    classes = written(first.unionByName(maybe.join(groups.select("uid"), "uid", "left_semi")), "class-sets")

    def full(wanted: DataFrame, *keep: str) -> DataFrame:
        """Whole sets of wanted(uid, doc_id, h1, h2) with the columns to keep."""
        maybe, _ = split_by_sketch(rows, "doc_id", wanted.select("doc_id"))
        kinds = dict(wanted.dtypes)
        out = maybe.join(wanted, "doc_id").select(*keep, "h1", "h2", "text").mapInArrow(_full_sets(size, keep), ", ".join(f"{c} {kinds[c]}" for c in keep) + ", tokens binary")
        return out.filter("tokens IS NOT NULL")

    def whole(uids: DataFrame) -> DataFrame:
        wanted = written(uids.join(groups, "uid").join(classes.select("uid", "n"), "uid"), "hub-classes")
        return full(wanted, "uid", "n").withColumnRenamed("tokens", "low")

    clusters = components(_candidates(classes, percent, whole))
    members = clusters.select(F.col("a").alias("uid"), F.col("b").alias("cluster")).unionByName(clusters.select(F.col("b").alias("uid"), F.col("b").alias("cluster")).distinct())
    members = members.join(classes.select("uid", "n"), "uid").join(groups, "uid")
    members = written(members, "members")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    wanted = members.join(sizes, "cluster").select("cluster", "uid", "parts", "doc_id", "h1", "h2")
    wanted = written(wanted, "wanted-sets")
    own = F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")
    blocks = full(wanted, "cluster", "uid", "parts").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # A block pairs part x with part y > x, or part x with itself; side tells the two parts apart.
    low, high = F.least("own", "other"), F.greatest("own", "other")
    blocks = blocks.select(F.concat_ws(":", "cluster", low, high).alias("key"), "uid", F.when(F.col("own") == low, 0).otherwise(1).alias("side"), "tokens")
    found = written(blocks.repartition("key").sortWithinPartitions("key").mapInArrow(_verifier(percent), "a long, b long, k long"), "links")
    links = found.groupBy(F.col("a").alias("uid")).agg(F.sum("k").alias("n_links"))
    roots = components(found.select("a", "b")).select(F.col("a").alias("uid"), F.col("b").alias("root"))
    placed = groups.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid")).join(links, "uid", "left")
    least = placed.groupBy("root").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("least"))
    labelled = placed.join(least, "root").select("h1", "h2", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "least")
    small = sets.select("doc_id", "n", "h1", "h2")
    linked = small.filter("n > 0 AND doc_id IS NOT NULL").join(labelled, ["h1", "h2"])
    first = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("h1") == F.col("least.h1")) & (F.col("h2") == F.col("least.h2"))
    linked = linked.select("doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), "n_links", "h1", "h2", first.alias("first"))
    alone = small.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "h1", "h2", F.lit(True).alias("first"))
    return linked.unionByName(alone)


def _signed(size: int) -> Callable:
    """Rows with the number and signature of their shingles in the last three columns."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            sets = list(shingle_sets(batch.column("_text"), size))
            signs = [_signature(s) for s in sets]
            found = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[k] for x in signs], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), batch.column("_text"), *found], names=["_row", "_id", "_text", "_n", "_h1", "_h2"])

    return lean(sign)


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, the one with the smallest doc_id; rows without words or id stay.

    Rows that share a doc_id are documents of their own: one that isn't linked with the others stays beside them. Of
    linked rows with the same smallest doc_id the one with the smallest shingle signature stays, then the one with the
    smallest text; of equal rows one stays. Extra columns may have any name. An empty table stays so.
    """
    keep = _labelled(docs, size, percent).filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("first").alias("_first"))
    keep = written(keep, "kept-signatures")
    shared = keep.groupBy("_id").count().filter("count > 1").select("_id")
    # One struct holds the row, so that no column of docs can clash with those of the joins.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    out = rows.filter("_id IS NULL").select("_row")
    if shared.isEmpty():
        return out.unionByName(rows.join(keep.filter("_first").select("_id"), "_id", "left_semi").select("_row")).select("_row.*")
    shared = written(shared, "shared-ids")
    out = out.unionByName(rows.join(shared, "_id", "left_anti").join(keep.filter("_first").select("_id"), "_id", "left_semi").select("_row"))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in ("_n", "_h1", "_h2"))])
    signed = rows.join(shared, "_id", "left_semi").mapInArrow(_signed(size), schema).join(keep.filter("_first").distinct(), ["_id", "_h1", "_h2"], "left_semi")
    best = signed.filter("_n > 0").groupBy("_id", "_h1", "_h2").agg(F.min(F.struct("_text", F.xxhash64(F.to_json("_row")), "_row")).alias("least"))
    return out.unionByName(signed.filter("_n = 0").select("_row")).unionByName(best.select("least._row")).select("_row.*")
