import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_mixing import targets
from tests.llm.test_ngram_join import brute as near_brute
from tests.llm.test_token_files import brute as token_brute

SF = "/root/testdata/sf0.001"
size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages(spark):
    """Every stage on what its predecessor kept, against a plain statement of what it does."""
    first = docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == first.columns
        seen.append(docs.collect())
    before = first.collect()
    harmless = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic == 0}
    assert sum(r.doc_id in harmless for r in before if r not in seen[0]) <= 0.05 * len(harmless)
    groups = near_brute([(r.doc_id, r.text) for r in seen[0]], 5, 80)
    assert sorted(r.doc_id for r in seen[1]) == sorted({c for _, _, c in groups})
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    grams = {tuple(w[i : i + 10]) for w in map(words, items) for i in range(len(w) - 9)}
    hit = lambda t: any(tuple(w[i : i + 10]) in grams for w in [words(t)] for i in range(len(w) - 9))
    clean = {r.doc_id: r.text for r in seen[1] if not hit(r.text)}
    after = {r.doc_id: r.text for r in seen[2]}
    assert all(after[i] == t for i, t in clean.items()) and not any(hit(t) for t in after.values()) and len(clean) < len(seen[1])
    assert all(r.n_chars == len(r.text) for r in seen[2])
    sizes, taken = Counter(), Counter()
    for r in seen[2]:
        sizes[r.source] += size(r.text)
    for r in seen[3]:
        taken[r.source] += size(r.text)
    longest = max(size(r.text) for r in seen[2])
    assert all(abs(taken[s] - t) <= longest for s, t in targets(dict(sizes)).items())
    assert max(Counter(r.doc_id for r in seen[3]).values()) <= 3
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == token_brute([(r.doc_id, r.text) for r in seen[3]])


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"empty-{name}")
        assert docs.count() == 0


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names, through every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["_toxicity", "_row", "_id", "_text", "_slot", "_dc_spans", "_dc_words", "_dc_items", "_copies", "_hash", "n_words", "size"]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    twin = "unrelated words that share an id with others " * 3
    rows += [(None, None, None, None, None), (None, twin, "en", None, 5), (None, twin, "en", None, 5), (7000, "", "en", "web", 0), (7000, twin + "first", "en", "web", 9), (7001, None, None, "web", None)]
    harmless = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic == 0}
    plain = next(r[1] for r in rows if r[0] in harmless and r[2] == "en" and len(r[1]) > 500)
    rows += [(7002, f"{plain}\n" * 1500, "en", "web", 1), (7003, "a tie", "en", "web", 5), (7004, "a tie", "en", "web", 5), (7004, "a tie", "en", "web", 5), (7005, "漢字 é \x00 \x1c", "de", "", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *[f"own {n}" for n in names]) for r in rows], schema).repartition(4)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        assert docs.columns == before.columns and [f.dataType for f in docs.schema] == [f.dataType for f in before.schema]
        got = docs.collect()
        assert all(r[n] == f"own {n}" for r in got for n in names), name
        if k != 2:
            assert {(r.doc_id, r.text) for r in got} <= {(r.doc_id, r.text) for r in before.collect()}
        if k < 2:
            assert {(None, None), (7001, None), (7000, ""), (None, twin), (7002, rows[-5][1])} - ({(7002, rows[-5][1])} if k else set()) <= {(r.doc_id, r.text) for r in got}, name
    sizes = Counter((r.doc_id, r.text) for r in got)
    assert all(size(t) for _, t in sizes)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(out) == len(got) and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)
