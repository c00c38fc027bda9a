import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelight import sql
from cuelight.functions import scoring as S
from cuelight.functions import text as X


def values(spark, rows, *columns, schema="x string"):
    """Each expression's value for each row."""
    return [tuple(r) for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).coalesce(1).select(*columns).collect()]


def clean(t, embed=True):
    t = re.sub(r"\{\\[^}]+\}", "", re.sub(r"<[^>]+>", "", t))
    if embed:
        t = re.sub("♪+", " ", re.sub(r"\([^)]*\)", " ", re.sub(r"\[[^\]]*\]", " ", t)))
    t = re.sub(r"\s+", " ", re.sub(r"^[-–—]\s*", "", t)).strip()
    return t.lower() if embed else t


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="aB<>{}\\()[]♪-– \n\t\xa0'é1", max_size=25), min_size=1, max_size=60))
def test_clean(spark, texts):
    got = values(spark, texts, X.clean_cue_text("x"), X.clean_cue_text("x", False), X.tokens("x"), X.normalize_key("x"))
    assert got == [(clean(t), clean(t, False), re.findall("[a-z0-9']+", t.lower()), re.sub(r"\s+", " ", t.strip().lower())) for t in texts]


def test_speaker(spark):
    rows = ["ALFRED: Hello", "- LANA: What?", "ONE TWO THREE FOUR FIVE: no", "MARY-ANN O'BRIEN J.R.: hi", "no name", " A :  b "]
    got = values(spark, rows, X.speaker("x")["speaker"], X.speaker("x")["body"])
    assert got == [("Alfred", "Hello"), ("Lana", "What?"), (None, rows[2]), ("Mary-Ann O'Brien J.R.", "hi"), (None, "no name"), ("A", "b")]


def test_times_and_labels(spark):
    assert values(spark, ["1:02:03,045", "00:00:01.5", "x"], X.timestamp_ms("x")) == [(3723045,), (None,), (None,)]
    assert values(spark, [3723045, 59999, -5], X.format_ms(F.greatest("x", F.lit(0))), X.ms_to_timestamp("x"), schema="x long") == [("1:02:03.045", "1:02:03"), ("0:00:59.999", "0:59"), ("0:00:00.000", "0:00")]
    paths = ["/a/Show.Name.S01E02.REL-x.srt", "b/S03E04.srt", "X.S01E01.srt", "s1e2.SRT"]
    assert [tuple(r[0]) for r in values(spark, paths, X.episode_of_path("x"))] == [(1, 2, "REL-x"), (3, 4, None), (None, None, None), (1, 2, None)]
    rows = [("s", 1, 2), ("s", 0, 1), ("s", None, 1)]
    assert values(spark, rows, X.cue_id("s", "a", "b", F.lit(7)), X.chunk_id("s", "a", "b", F.lit(7)), schema="s string, a int, b int") == [("s_S01E02_00007", "s_S01E02_00007"), ("s_S00E01_00007", "s_00007"), ("s_00007", "s_00007")]
    assert values(spark, [5.0, 90.0, 9000.0], X.format_seconds("x"), schema="x double") == [("5.0s",), ("1.5m",), ("2.5h",)]
    assert values(spark, ["a b/c!", "__x__"], X.safe_name("x")) == [("a_b_c",), ("x",)]


def test_decode_and_head(spark):
    rows = [b"caf\xe9", "café".encode(), b"\xef\xbb\xbfx", b"<!DOCTYPE HTML><p>"]
    assert values(spark, rows, X.decode_text("x"), X.html_wrapper("x"), schema="x binary") == [("café", False), ("café", False), ("x", False), ("<!DOCTYPE HTML><p>", True)]


def test_query_words(spark):
    rows = ["hungry hungry hippo", "Some men just want to watch the world burn", "That's how you get ants", "it is the", "a 7 b", "alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon zeta eta theta iota"]
    got = values(spark, rows, X.distinctive_tokens("x"), X.lexical_mode(X.distinctive_tokens("x")))
    assert [" ".join(w) for w, _ in got[:5]] == ["hungry hungry hippo", "men want watch world burn", "that's how get ants", "", "7"]
    assert [m for _, m in got] == ["strict", "soft", "strict", "off", "strict", "soft", "off"]
    assert values(spark, [("x", ["an", "an", "zz"])], X.token_hits("w", F.lit("banana")), schema="x string, w array<string>") == [(2,)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
    return row[-1]


def slow_ratio(a, b):
    if len(a) > len(b):
        a, b = b, a
    n, best = len(a), 0.0
    for s, t in ((a, b), (b, a))[: 2 if len(a) == len(b) else 1]:
        slices = [t[:k] for k in range(1, n)] + [t[k : k + n] for k in range(len(t) - n + 1)] + [t[-k:] for k in range(1, n + 1)]
        best = max([best, *(200 * lcs(s, u) / (len(s) + len(u)) for u in slices)])
    return best


@settings(max_examples=400, deadline=None)
@given(st.text("abc ", min_size=1, max_size=9), st.text("abc ", min_size=1, max_size=16))
def test_partial_ratio(a, b):
    assert abs(S.partial_ratio_of(a, b) - slow_ratio(a, b)) < 1e-9


def test_scores(spark):
    rows = [("strict", 2, 0, 0.1), ("strict", 2, 1, 0.95), ("strict", 4, 2, 0.1), ("strict", 4, 1, 0.1), ("soft", 5, 0, 0.3), ("soft", 5, 0, 0.9), ("soft", 5, 1, 0.3), ("off", 0, 0, 1.0)]
    score, note = S.guardrail(F.lit(1.0), F.col("m"), F.col("n"), F.col("h"), F.col("f"), S.GuardrailConfig.of({"soft_boost": 2, "unknown": 1}).columns())
    got = values(spark, rows, score, note, schema="m string, n int, h int, f double")
    assert [g for g, _ in got] == [-2.0, 1.75, 1.25, 1.0, 0.0, 3.0, 1.0, 1.0] and got[3][1] is None and got[0][1].startswith("strict")
    assert values(spark, [("kitten", "sitting"), ("", "a"), ("abcab", "cabab")], S.longest_common_substring(F.col("a"), F.col("b")), schema="a string, b string") == [(3,), (0,), (3,)]
    assert values(spark, [("a b", "c d")], S.line_fuzzy(F.lit(""), F.col("a")), S.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))), F.round(S.blended(F.lit(1.0), F.lit(0.0), F.lit(1.0)), 6), schema="a string, b string") == [(0.0, 0.5, 0.70)]


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("""SELECT clean_cue_text('- <b>Hi</b> (x) THERE') a, whitespace_tokens("It's 2") b, cosine(array(float(1), float(2)), array(float(3), float(4))) c, ms_to_timestamp(3723045) d, lexical_mode(array('a1')) e, partial_ratio('abc', 'xxabcxx') f""").first()
    assert tuple(row) == ("hi there", ["it's", "2"], 11.0, "1:02:03", "strict", 100.0)
