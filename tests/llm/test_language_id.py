import itertools

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelight.llm.language_id import NAMES, _words, fit, identify, language_report, viterbi

SCHEMA = "doc_id long, text string, lang string, score string, spans int"
EN, DE, RU = "the house and the garden with that thing", "das haus und der garten mit einem schönen tag", "дом и сад с этим человеком"


def brute(scores, switch):
    k = scores.shape[1]
    return max(sum(scores[i, s] for i, s in enumerate(p)) - switch * sum(a != b for a, b in itertools.pairwise(p)) for p in itertools.product(range(k), repeat=len(scores)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(*[st.integers(-9, 0)] * 3), max_size=6), max_size=5), st.integers(1, 12))
def test_viterbi(rows, switch):
    scores = np.array([w for r in rows for w in r], np.float32).reshape(-1, 3)
    first = np.cumsum([0, *map(len, rows)])
    path = viterbi(scores, first, switch)
    for a, b in itertools.pairwise(first):
        if b > a:
            got = sum(scores[i, path[i]] for i in range(a, b)) - switch * sum(path[i] != path[i + 1] for i in range(a, b - 1))
            assert abs(got - brute(scores[a:b], switch)) < 1e-6


def rows():
    train = [(i, f"{t} {i} {t}", lang, "clash", 1) for i in range(60) for t, lang in [((EN, "en"), (DE, "de"), (RU, "ru"))[i % 3]]]
    return [*train, (100, None, "en", "", 1), (101, "", "en", "", 1), (102, "12 — !? 34", "de", "", 1), (103, f"{EN} {EN} {RU}", None, "", 1), (103, f"{RU} x", None, "", 1), (None, DE.upper(), None, "", 1), (104, "漢字", None, "", 1), (105, f"{EN} " * 2000, None, "", 1)]


def test_cases(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {(r.doc_id, r.lang_pred) for r in language_report(df).collect()}
    assert got >= {(100, "und"), (101, "und"), (102, "und"), (103, "en"), (103, "ru"), (None, "de"), (105, "en"), *((i, ("en", "de", "ru")[i % 3]) for i in range(60))}
    spans = [r.spans for r in identify(df.filter("doc_id = 103"), fit(df), True).collect() if len(r.spans) == 2]
    assert [(s.lang, s.n_words) for s in spans[0]] in ([("en", 16), ("ru", 6)], [("ru", 6), ("en", 1)])
    assert language_report(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_report(df.withColumn("lang", df.lang.substr(9, 1)).filter("false").union(df.limit(0))).collect()} == set()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = language_report(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in both) > 0.98 * len(both)


def test_rare_language_is_learned_whole(spark):
    rare = [(90_000 + i, RU, "ru", "", 1) for i in range(5)]
    common = [(i, f"{EN} {i}", "en", "", 1) for i in range(3000)] + [(10_000 + i, f"{DE} {i}", "de", "", 1) for i in range(3000)]
    df = spark.createDataFrame([*common, *rare], SCHEMA)
    model = fit(df, 60)
    assert model.languages == ["de", "en", "ru"]
    asked = spark.createDataFrame([(1, RU, None, "", 1)], SCHEMA)
    assert [s.lang for s in identify(asked, model, True).first().spans] == ["ru"]


def test_more_languages_than_a_byte_holds(spark):
    """140 languages, each of a few words of its own: those beyond the 128th are learned too."""
    rng = np.random.default_rng(7)
    own = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(8)) for _ in range(140)]
    text = lambda i: own[i]
    rows = [(i * 10 + j, f"{text(i)} {text(i)}", f"l{i:03d}", "", 1) for i in range(140) for j in range(4)]
    got = language_report(spark.createDataFrame(rows, SCHEMA)).collect()
    right = [r.lang_pred == f"l{r.doc_id // 10:03d}" for r in got if r.doc_id >= 1280]
    assert len(right) == 48 and sum(right) >= 46


def test_unknown_script_has_no_score(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    asked = spark.createDataFrame([(1, "漢字 漢字", None, "", 1), (2, "ქართული ენა", None, "", 1), (3, f"{EN} 漢字漢字漢字漢字", None, "", 1)], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(asked, fit(df)).collect()}
    assert got[1][1] == got[2][1] == 0.0 and got[1][0] in ("de", "en", "ru")
    assert got[3][0] == "en" and 0 < got[3][1] < 1


def test_scripts_by_code_point():
    want = {"latin": "straße ǆ ḁ “quoted” plain", "greek": "λόγος ὀδός", "cyrillic": "дом ꙁ", "georgian": "ქართული", "khmer": "ខ្មែរ", "ethiopic": "አማርኛ", "burmese": "မြန်မာ", "arabic": "عربي ݐ ﻋ", "han": "漢字 𠀀", "kana": "かな カナ ｶﾅ", "hangul": "한글 ᄀ", "hebrew": "עברית", "thai": "ไทย", "armenian": "հայ", "devanagari": "हिन्दी"}
    for name, text in want.items():
        script = _words(pa.array([text]))[4]
        assert len(script) and {NAMES[k] for k in script.tolist()} == {name}, name
