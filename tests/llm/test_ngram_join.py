import random
import re

from pyspark.sql import functions as F

from cuelight.llm import ngram_join
from cuelight.llm.components import components
from cuelight.llm.ngram_join import choose_boundary, jaccard_components, one_of_each

SCHEMA = "doc_id long, text string, n string, uid string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(docs, size=4, percent=85):
    sets = [(i, shingles(t, size)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, s) in enumerate(sets):
        for y, (j, t) in enumerate(sets[:x]):
            if i is not None and j is not None and s and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(x), find(y)
                root[a] = b
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(s), None if i is None else least[find(x)]) for x, (i, s) in enumerate(sets)), key=str)


def corpus(seed=3, n=420):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(900)}"
    passage = [word() for _ in range(40)]
    base = [word() for _ in range(90)]
    docs = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = [word() for _ in range(rng.choice([3, 5, 9, 12, 30, 70]))]
        elif kind == 1:
            t = [word() for _ in range(rng.randrange(80))] + passage + [word() for _ in range(rng.randrange(60))]
        elif kind in (2, 3):  # a family of near copies
            t = list(base)
            for _ in range(rng.randrange(7)):
                t[rng.randrange(len(t))] = word()
            t = t[: len(t) - rng.randrange(3)]
        elif kind == 4 and docs:
            t = (docs[rng.randrange(len(docs))][1] or "").split(" ")
            if rng.random() < 0.7 and len(t) > 2:
                t[rng.randrange(len(t))] = word()
        else:
            t = [f"small{i % 40}"] + [f"x{k}" for k in range(i % 13)]
        docs.append((i, " ".join(t)))
    return [*docs, (3, "another text of the same id as three"), (n, None), (n + 1, ""), (n + 2, " \n"), (None, docs[2][1]), (n + 3, docs[2][1].upper()), (n + 3, docs[2][1])]


def check(spark, docs, *how):
    df = spark.createDataFrame([(*d, "clash", "clash") for d in docs], SCHEMA).repartition(3)
    got = jaccard_components(df, *how).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs, *how)
    return df, got


def test_like_brute_force(spark):
    df, got = check(spark, corpus())
    kept = one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    # Two unrelated texts share the id 3 and are components of their own.
    assert [r.component_id for r in got if r.doc_id == 3] == [3, 3] and sorted(ids) == sorted([*{r.component_id for r in got} - {None}, 3])


def test_rows_that_share_an_id(spark):
    """Unrelated texts of one id stay, near copies of any id go, and reruns keep the same rows."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    docs = [(1, a, "x", "_row"), (1, b, "y", "_row"), (2, f"{a} more", "z", "_row"), (2, c, "u", "_row"), (3, b, "v", "_row"), (2, c, "u", "_row"), (2, c.upper(), "t", "_row"), (4, None, "w", "_row"), (4, "", "w", "_row"), (None, a, "n", "_row"), (None, a, "n", "_row")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _h1 string, first string")
    want = sorted([(1, a, "x", "_row"), (1, b, "y", "_row"), (2, c.upper(), "t", "_row"), (4, None, "w", "_row"), (4, "", "w", "_row"), (None, a, "n", "_row"), (None, a, "n", "_row")], key=str)
    for n in (1, 3, 5):
        kept = one_of_each(df.repartition(n), 5, 80)
        assert kept.schema == df.schema and sorted(map(tuple, kept.collect()), key=str) == want


def test_long_lists_and_blocks(spark, monkeypatch):
    """Tiny limits: heavy shingles, hubs of lists and clusters over several blocks."""
    monkeypatch.setattr(ngram_join, "HEAVY_FROM", 3)
    monkeypatch.setattr(ngram_join, "HEAVY_MAX", 20)
    monkeypatch.setattr(ngram_join, "LIST_MAX", 5)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    check(spark, corpus(5, 240))


def test_common_passages_chain_no_clusters(spark, monkeypatch):
    """Texts that share half of their words with many others, but link with none of them, aren't compared as one cluster."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(30)] for _ in range(12)]
    docs = [(i, " ".join(passages[i % 12] + [word() for _ in range(60)] + passages[(i // 12) % 12])) for i in range(288)]
    docs += [(288 + i, docs[i][1] + " more") for i in range(3)]
    real, wanted = ngram_join.written, []

    def counted(df, name):
        out = real(df, name)
        if name == "wanted-sets":
            wanted.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    check(spark, docs)
    assert wanted == [6]


def test_small_sets_by_subsets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "choose_boundary", lambda *a: 30)
    check(spark, corpus(7, 240), 5, 80)
    assert choose_boundary({10: 100, 20: 1, 300: 100}, 5.0, 85) == 20 and choose_boundary({300: 100}, 0.0, 85) == 0


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in root if find(x) != x}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(r) for r in components(df).collect()} == want
    assert components(df.filter(F.lit(False))).count() == 0
