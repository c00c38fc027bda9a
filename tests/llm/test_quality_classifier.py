import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from cuelight.llm.fitting import held_out
from cuelight.llm.quality_classifier import _train, dual_descent, fit_indicators, indicators, margins, quality_report

DOCS = "doc_id long, text string, quality string, _quality string"


def test_dual_descent_reaches_the_optimum():
    """Primal and dual objectives meet, and neighbours of the solution are no better."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=80) > 0, 1, -1)
    w, b = dual_descent([np.arange(6)] * 80, list(x), y, 6, rounds=3000)
    cost = np.where(y > 0, 80 / (2 * (y > 0).sum()), 80 / (2 * (y < 0).sum()))
    loss = lambda v: (v @ v) / 2 + (cost * np.maximum(0, 1 - y * (x @ v[:6] + v[6]))).sum()
    best = loss(np.append(w, b))
    assert all(best <= loss(np.append(w, b) + rng.normal(size=7) * s) + 1e-3 for s in (1e-3, 1e-2, 1e-1) for _ in range(50))


def test_indicators_do_not_cross_rows():
    alone = [indicators(pa.array([t], pa.string()))[1].tolist() for t in ("Some words here", "", "AND!! MORE!! of of of", None)]
    rows, buckets = indicators(pa.array(["Some words here", "", "AND!! MORE!! of of of", None]))
    assert [buckets[rows == k].tolist() for k in range(4)] == alone and alone[1] == alone[3] == []


def test_margins_are_those_of_the_fitted_vectors():
    """Scoring against the plain statement: unit vectors of log-count ratios, weighed and shifted."""
    texts = ["good plain words", "good plain lines here", "BAD!! BAD!! CHEAP", "CHEAP!! BAD!!", "", "never seen 123"]
    at, buckets = indicators(pa.array(texts))
    each = [buckets[at == k] for k in range(len(texts))]
    y = np.array([1, 1, -1, -1])
    weights, squares, bias = _train(each[:4], y)
    seen = {k: {} for k in (1, -1)}
    for f, k in zip(each, y.tolist(), strict=False):
        for x in f.tolist():
            seen[k][x] = seen[k].get(x, 0) + 1
    size = len(weights)
    total = {k: size + sum(seen[k].values()) for k in seen}
    ratio = lambda x: np.log((1 + seen[1].get(x, 0)) / total[1]) - np.log((1 + seen[-1].get(x, 0)) / total[-1])
    got = margins(at, buckets, len(texts), weights, squares, bias)
    vectors = [np.array([ratio(x) for x in f.tolist()]) for f in each]
    unit = [v / np.sqrt(v @ v) if len(v) else v for v in vectors]
    inner, b = dual_descent(each[:4], unit[:4], y, size)
    assert np.allclose(got, [inner[f] @ u + b if len(f) else b for f, u in zip(each, unit, strict=True)])


def test_held_out_accuracy(spark):
    docs, labels = (pq.read_table(f"/root/testdata/sf0.1/{t}.parquet").to_pandas() for t in ("documents", "labels"))
    rows = docs.merge(labels, on="doc_id").head(2000)
    ids = spark.createDataFrame(rows[["doc_id"]])
    out = np.array([r[0] for r in ids.coalesce(1).select(held_out(ids.doc_id)).collect()])
    at, buckets = indicators(pa.array(rows.text))
    each = np.split(buckets, np.searchsorted(at, np.arange(1, len(rows))))
    model = fit_indicators([f for f, o in zip(each, out, strict=True) if not o], rows.quality[~out].to_numpy())
    margin = margins(at, buckets, len(rows), model.weights, model.squares, model.bias)[out]
    good = model.curve[0] * margin + model.curve[1] > np.log(0.3 / 0.7)
    assert (good == (rows.quality[out] == 1)).mean() > 0.97


def test_cases(spark):
    plain = "Some plain words make a line that goes on and ends here, as one would expect."
    rows = [(i, f"{plain} {i} {plain.lower()}" if i % 4 else f"BUY!! NOW!! {i} " + "CHEAP!! " * 30) for i in range(120)]
    odd = [(500, None), (501, ""), (502, " "), (None, plain), (503, "SALE!! " * 9000), (503, plain)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows + odd], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows] + [(3, None, 1)], "doc_id long, quality int, toxic int")
    got = quality_report(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r.predicted for r in got if r.doc_id is not None and r.doc_id < 500}
    assert all(by[i] == int(i % 4 > 0) for i, _ in rows)
    assert len({r.score for r in got if r.doc_id in (500, 501)}) == 1
    assert quality_report(docs.limit(0), labels).count() == 0 and quality_report(docs, labels.limit(0)).count() == len(got)
