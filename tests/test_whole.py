"""Queries over whole query sets and whole texts, against brute force."""

import numpy as np

from cuelight.functions import scoring as S
from cuelight.operators.evaluate import KEY_NEIGHBORS
from cuelight.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def vectors(spark):
    """Ids, labels, the places of the query rows, and all scores of these."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, labels = [r.vec_id for r in rows], [r.label for r in rows]
    m = np.array([r.embedding for r in rows], np.float64)
    asked = [k for k, i in enumerate(ids) if i % 20 == 0]
    return ids, labels, asked, m[asked] @ m.T


def capped(spark, n):
    """(query, item, label, rank) of five results with two of a label, out of the n nearest."""
    ids, labels, asked, scores = vectors(spark)
    out = []
    for k, s in zip(asked, scores, strict=True):
        kept = []
        for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:n]:
            if len(kept) < 5 and sum(labels[x] == labels[j] for x in kept) < 2:
                kept.append(j)
        out += [(ids[k], ids[j], labels[j], r) for r, j in enumerate(kept, 1)]
    return out


def test_nearest_of_every_twentieth(spark):
    ids, _, asked, scores = vectors(spark)
    want = sorted((ids[k], ids[j]) for k, s in zip(asked, scores, strict=True) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:20])
    for name in ("ann_topk", "ann_topk_blocks"):
        assert sorted((r.q, r.vec_id) for r in QUERIES[name](spark, SF).collect()) == want


def test_capped_of_every_twentieth(spark):
    want = sorted(capped(spark, 200))
    assert sorted((r.q, r.vec_id, r.label, r.rank) for r in QUERIES["ann_topk_capped"](spark, SF).collect()) == want
    assert sorted((r.q, r["rank"]) for r in QUERIES["confidence_band"](spark, SF).collect()) == sorted((q, r) for q, _, _, r in want)
    ids, labels, asked, _ = vectors(spark)
    own = {ids[k]: labels[k] for k in asked}
    first = {q: min((r for p, i, label, r in want if p == q and i != q and label == own[q]), default=None) for q in own}
    got = QUERIES["recall_eval"](spark, SF).first()
    assert got.n == len(own) and abs(got.mrr - np.mean([1 / r if r else 0 for r in first.values()])) < 1e-6
    assert QUERIES["guardrail_grid"](spark, SF).count() == 6


def talk(spark, path, n):
    """n conversations of three turns, two of them of two lines; the words of a turn say where it is only at its end."""
    rows = [(c, k, "user", f"so this line opens like all other lines do here\nand then comes word{(7 * c + k) % 11} with <b>sign{c % 5}</b> at turn{k} of {c}") for c in range(n) for k in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return rows


def test_queries_are_whole_lines_of_every_twentieth(spark, tmp_path):
    clean = {f"q{c}_{k}": t.replace("<b>", "").replace("</b>", "").replace("\n", " ") for c, k, _, t in talk(spark, tmp_path, 13)}
    want = {}
    for q in ("q0_0", "q0_1", "q0_2"):
        scores = sorted(((-S.partial_ratio_of(clean[q], t), i) for i, t in clean.items()))
        want[q] = [-round(s / 100, 6) for s, _ in scores[:3]]
    got = {}
    for r in sorted(QUERIES["partial_ratio_topk"](spark, str(tmp_path)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.fuzzy_score)
    assert got == want
    found = QUERIES["hybrid_search"](spark, str(tmp_path)).filter("rank = 1").collect()
    assert {r.query_id for r in found} == set(want) and all(r.episode == 0 for r in found)


def test_partial_ratios_in_blocks():
    rng = np.random.default_rng(5)
    text = lambda top: "".join(rng.choice(list("abc é"), rng.integers(0, top)))
    pairs = [(text(9), text(17)) for _ in range(600)] + [(text(9), text(9)) for _ in range(600)]
    assert S.partial_ratios(pairs) == [S.partial_ratio_of(*p) for p in pairs]


def test_gate_lets_other_labels_in(spark, tmp_path):
    rows = [(i, [1 - i / 1000], 0 if i < 150 else i) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["ann_topk_capped"](spark, str(tmp_path)).filter("q = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 150, 151, 152]


def test_gate_lets_fuzzy_matches_in(spark, tmp_path):
    said = "marmalade sandwiches every afternoon"
    rows = [(0, 0, "user", said)] + [(1, k, "user", "marmalad3 sandwichs everi afternon") for k in range(2)]
    rows += [(c, k, "user", f"every marmalade and {c} afternoon {k}") for c in range(2, 20) for k in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = sorted((round(S.partial_ratio_of(said, r[3]) / 100, 6) for r in rows), reverse=True)[:3]
    got = QUERIES["partial_ratio_topk"](spark, str(tmp_path)).filter("query_id = 'q0_0'").orderBy("rank").collect()
    assert [r.fuzzy_score for r in got] == want and want[1] > 0.8


def items(spark, path):
    """Items whose telling words come late, one strict, one soft and one without a mode."""
    rows = [(0, "the and of zebra tune7"), (1, "violet crayon yonder meadow lantern harvest"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    said = ["nothing here", "a zebra and tune7 at last", "kappa alone", "violet crayon yonder meadow lantern harvest", "the and of zebra tune7"]
    lines = [(c, k, "user", said[(c + k) % 5]) for c in range(4) for k in range(3)]
    spark.createDataFrame(lines, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return [["zebra", "tune7"], rows[1][1].split(), rows[2][1].split()], [t for _, t in rows], lines


def test_hits_of_all_cues_and_whole_items(spark, tmp_path):
    words, texts, lines = items(spark, tmp_path)
    hits = {(i, c, k): sum(w in t for w in ws) for i, ws in enumerate(words) for c, k, _, t in lines}
    got = QUERIES["token_hits"](spark, str(tmp_path)).collect()
    assert sorted((r.item_id, r.episode, r.pos, r.hits) for r in got) == sorted((*key, n) for key, n in hits.items() if n)
    want = {0: 0.0, 1: 0.0, 2: 0.0}
    for (i, c, k), n in hits.items():
        fuzzy = S.partial_ratio_of(texts[i], next(t for a, b, _, t in lines if (a, b) == (c, k))) / 100
        if i == 0:
            want[i] += -3.0 if n == 0 else 0.75 if fuzzy >= 0.9 else 0.25
        if i == 1:
            want[i] += 0.5 if fuzzy >= 0.85 else -1.0 if n == 0 and fuzzy < 0.4 else 0.0
    found = {r.item_id: (r.n_lines, r.total) for r in QUERIES["guardrail_whole"](spark, str(tmp_path)).collect()}
    assert found == {i: (len(lines), x) for i, x in want.items()}


def typos(q):
    """The first six deletions, swaps and neighbouring keys by place, of a text in lower case with single blanks."""
    out, seen = [], {q.strip()}
    for i, ch in enumerate(q):
        swap = [q[:i] + q[i + 1] + ch + q[i + 2 :]] if i + 1 < len(q) else []
        for v in [q[:i] + q[i + 1 :], *swap, *(q[:i] + k + q[i + 1 :] for k in KEY_NEIGHBORS.get(ch, ""))]:
            if v.strip() not in seen and len(v) >= 3 and len(out) < 6:
                seen.add(v.strip())
                out.append(v)
    return out


def test_typos_and_modes_of_whole_items(spark, tmp_path):
    words, texts, _ = items(spark, tmp_path)
    got = {}
    for r in QUERIES["typo_variants"](spark, str(tmp_path)).orderBy("item_id", "place").collect():
        got.setdefault(r.item_id, []).append(r.variant)
    assert got == {i: typos(t) for i, t in enumerate(texts)} and any(v.startswith("rhe") for v in got[0])
    modes = sorted(tuple(r) for r in QUERIES["lexical_mode"](spark, str(tmp_path)).select("item_id", "words", "mode").collect())
    assert modes == [(i, " ".join(w), m) for i, (w, m) in enumerate(zip(words, ("strict", "soft", "off"), strict=True))]


def test_speakers_of_every_line(spark, tmp_path):
    rows = [(1, 0, "user", "hello\nLANA: what?\nno name"), (1, 1, "assistant", "one")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in QUERIES["speaker_extract"](spark, str(tmp_path)).select("turn", "line_no", "speaker", "body").collect())
    assert got == [(0, 0, "User", "hello"), (0, 1, "Lana", "what?"), (0, 2, None, "no name"), (1, 0, "Assistant", "one")]
