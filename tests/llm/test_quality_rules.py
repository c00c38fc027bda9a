import re

from pyspark.sql import functions as F

from cuelight.llm.quality_rules import Rule, hashed_sample, order_rules, quality_documents, quality_rules

SCHEMA = "doc_id long, text string, n_words string, kept string"
TEXTS = [None, "", "  \n\t ", "a b c d e", "a b c d e a b c d e", "x " * 100, "one two\none two\n\n\none two\nthree #*$%&|<>", "é漢 字\x0b\x0cz",
         " ".join(str(i % 7) for i in range(40)), " ".join(map(str, range(3000))) + " 5 6 7 8 9", "A plain text of words that says rather little, yet has no fault at all in it."]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(words) < 1000 else {*range(5, 10), *range(3000, 3005)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures(spark):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    for i, t in enumerate(TEXTS):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)
    assert got[10].kept and not got[6].kept


def test_empty_and_order(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert quality_rules(df).count() == 0
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(TEXTS)], SCHEMA).select("text")
    never, often = Rule("never", F.col("n_words") < 0), Rule("often", F.col("n_words") < 50)
    assert [r.name for r in order_rules(docs, [never, often])] == ["often", "never"]
    assert not any(r.kept for r in quality_rules(docs, [Rule("all", F.lit(True))]).collect())


def test_native(spark):
    plan = quality_rules(spark.createDataFrame([(1, "a", "", "")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_any_column_name(spark):
    names = ["doc_id", "text", "_text", "_words", "n_words", "kept", "_row"]
    df = spark.createDataFrame([(i, t, *["own"] * 5) for i, t in enumerate(TEXTS)], "doc_id long, " + ", ".join(f"{n} string" for n in names[1:]))
    got = quality_rules(df).collect()
    assert all(r._text == r._words == r._row == "own" for r in got)
    kept = quality_documents(df)
    assert kept.schema == df.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_sample_is_bounded_and_spread(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(16)
    texts = [int(r.text.split()[1]) for r in hashed_sample(df, 500).collect()]
    assert 400 < len(texts) < 600 and min(texts) < 1000 and max(texts) > 19_000
    plan = quality_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Limit" not in plan


def test_later_measures_wait(spark):
    """The filter tries rules in a CASE, which stops at the first that rejects."""
    plan = quality_documents(spark.createDataFrame([(1, "a", "", "")], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan.split("Filter", 1)[1]
