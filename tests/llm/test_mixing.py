import re

import pytest

from cuelight.llm.mixing import mix_sources, mixed_documents, mixed_schedule

SCHEMA = "doc_id long, text string, source string, size long, target string"


def rows(n=400):
    out = []
    for i in range(n):
        source = [None, "a", "b", "c", "d"][i % 5] if i % 3 else "a"
        out.append((i, " ".join(["w"] * (i * 37 % 90)), source, 1, "clash"))
    return [*out, (1, None, "only", 0, ""), (1, "", None, 0, ""), (2, "twin", "b", 0, ""), (2, "twin", "b", 0, ""), (7, "x " * 9000, "d", 0, "")]


def targets(sizes):
    """Rounds of stopping and resharing, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    stopped = {}
    while True:
        free = [s for s in order if s not in stopped]
        level = (sum(sizes.values()) - sum(stopped.values())) / max(1, sum(weight[s] for s in free))
        above = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not above:
            return stopped | {s: weight[s] * level for s in free}
        stopped |= {s: 3 * sizes[s] for s in above}


def test_mix(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    got = mix_sources(df).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows())
    sizes = {}
    for r in rows():
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    want = targets(sizes)
    by_target = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by_target[(r.source_size, round(r.target, 6))] = by_target.get((r.source_size, round(r.target, 6)), 0) + r.taken
    assert by_target == {(sizes[s], round(want[s], 6)): round(want[s]) for s in sizes}
    assert sorted(map(tuple, mix_sources(df.repartition(3)).collect())) == sorted(map(tuple, got))


def test_schedule_spreads_sources(spark):
    """Every prefix of the schedule holds each source near its share."""
    _, targets, slots, _ = mixed_schedule(spark.createDataFrame(rows(), SCHEMA))
    seen, total = {}, 0
    want = {r.sid: r.words for r in targets.collect()}
    slots = slots.orderBy("slot").collect()
    for r in slots[: len(slots) // 2]:
        seen[r.sid] = seen.get(r.sid, 0) + r.n_words
        total += r.n_words
    for sid, words in want.items():
        assert abs(seen.get(sid, 0) / total - words / sum(want.values())) < 0.02


@pytest.mark.parametrize("data", [[], [(1, None, "a", 1, ""), (2, " ", None, 1, "")]])
def test_no_words(spark, data):
    got = mix_sources(spark.createDataFrame(data, SCHEMA)).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * len(data)


def test_tiny_source_keeps_other_blocks(spark):
    """A source of three words has blocks of its own size; the others' blocks stay."""
    plain = [(i, "w " * 400, "ab"[i % 2], 1, "") for i in range(200)]
    count = {}
    for name, data in (("plain", plain), ("tiny", [*plain, (999, "only three words", "c", 1, "")])):
        _, targets, slots, pieces = mixed_schedule(spark.createDataFrame(data, SCHEMA))
        count[name] = slots.count(), pieces.count()
        assert {r.source: r.block for r in targets.collect() if r.source != "c"} == {"a": 133, "b": 266} or name == "tiny"
    assert all(b < 1.1 * a + 250 for a, b in zip(count["plain"], count["tiny"], strict=True))


def test_documents_lie_in_the_schedule(spark):
    """Files hold the sources' words evenly, first to last; unrelated columns pass unharmed."""
    data = [(i, "w " * (20 + i % 50), "abc"[i % 3], f"copy {i}", "hash") for i in range(1500)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, _copies string, _hash string")
    got = mixed_documents(docs)
    assert got.schema == docs.schema
    got = got.collect()
    total, seen = sum(len(r.text.split()) for r in got), {}
    by = {}
    for r in got:
        by[r.source] = by.get(r.source, 0) + len(r.text.split())
    half = 0
    for r in got:
        if half < total / 2:
            half += len(r.text.split())
            seen[r.source] = seen.get(r.source, 0) + len(r.text.split())
    assert all(abs(seen[s] / half - by[s] / total) < 0.02 for s in by)
    assert all(r._copies == f"copy {r.doc_id}" and r._hash == "hash" for r in got)


def test_documents_odd_cases(spark):
    data = [*rows(), *[(None, "same words here", "a", 1, "")] * 40, (None, None, "a", 1, "")]
    docs = spark.createDataFrame(data, SCHEMA)
    got = mixed_documents(docs).collect()
    counts = {}
    for r in got:
        counts[(r.doc_id, r.text)] = counts.get((r.doc_id, r.text), 0) + 1
    have = {}
    for i, t, *_ in data:
        have[(i, t)] = have.get((i, t), 0) + 1
    assert all(n <= 3 * have[k] for k, n in counts.items()) and all(t and t.split() for _, t in counts)
    assert mixed_documents(docs.limit(0)).count() == 0
