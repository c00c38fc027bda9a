import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from cuelight.llm.decontamination import contamination_report, decontaminate

DOCS = "doc_id long, text string, item_id string, _spans int"
ITEMS = "item_id long, text string, doc_id long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        d, hit, ids = words(text), set(), set()
        for item_id, item in items:
            b = words(item)
            m = min(window, len(b))
            grams = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m else set()
            for i in range(len(d) - m + 1 if m else 0):
                if tuple(d[i : i + m]) in grams:
                    hit |= {*range(i, i + m)}
                    ids.add("null" if item_id is None else str(item_id))
        out.append((doc_id, len(d), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


LETTERS = st.lists(st.sampled_from("abc"), max_size=14).map(" ".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(LETTERS, max_size=12), st.lists(LETTERS, min_size=1, max_size=5), st.integers(1, 5))
def test_like_brute_force(spark, docs, items, window):
    docs, items = list(enumerate(docs)), list(enumerate(items))
    got = contamination_report(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string").coalesce(1), window)
    assert sorted(map(tuple, got.collect())) == brute(docs, items, window)


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, "Short item, here!"), (None, "é漢 x"), (10, None), (11, "..."), (1, "another text of the same id that is ten words long")]
    docs = [(1, None), (2, ""), (3, f"Before it {long.upper()} and after"), (3, "a SHORT-item here"), (None, "x é漢, X y"), (5, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (6, "pad " * 5000 + long)]
    d = spark.createDataFrame([(*r, "clash", 3) for r in docs], DOCS)
    b = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, contamination_report(d, b).collect()), key=key) == sorted(brute(docs, items, 10), key=key)
    kept = {(r.doc_id, r.text, r._spans) for r in decontaminate(d, b).collect()}
    assert kept == {(1, None, 3), (None, "x  y", 3), (2, "", 3), (5, docs[5][1], 3), (6, "pad " * 5000, 3)}
    assert {r.text for r in decontaminate(d, b, max_coverage=0.95).collect()} >= {"Before it  and after", "a "}
    assert contamination_report(d.limit(0), b).count() == 0 and not any(r.contaminated for r in contamination_report(d, b.limit(0)).collect())
