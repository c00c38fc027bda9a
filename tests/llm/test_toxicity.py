import numpy as np
import pyarrow.parquet as pq

from cuelight.llm.fitting import held_out
from cuelight.llm.toxicity import Buckets, drop_toxic, fit_texts, toxicity_report, windows

DOCS = "doc_id long, text string, toxic string, _toxicity string"


def data():
    rng = np.random.default_rng(1)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su") for b in ("nar", "tel", "bing", "lost", "dern")]
    rows = []
    for i in range(300):
        ws = list(rng.choice(plain, 40))
        if i % 4 == 0:
            ws[7], ws[20] = rng.choice(["grobian", "schurke", "fiesling"], 2)
        rows.append((i, " ".join(ws), int(i % 4 == 0)))
    return rows


def test_held_out_and_cases(spark):
    rows = data()
    odd = [(1000, None), (1001, ""), (1002, "12 !?"), (1003, "lonar " * 20_000 + "grobian schurke"), (None, "mitel rabing"), (1004, "y" * 5000)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t, _ in rows] + [(*r, "clash", "clash") for r in odd], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity_report(docs, labels).collect()}
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(got[i].predicted == y for i, _, y in rows if got[i].held_out)
    assert got[1003].predicted == 1 and not any(got[k].predicted for k in (1000, 1001, 1002, None))
    kept = drop_toxic(docs, labels)
    assert kept.schema == docs.schema and {r._toxicity for r in kept.collect()} == {"clash"} and kept.count() == sum(1 for r in got.values() if not r.predicted)
    assert toxicity_report(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity_report(docs, labels.limit(0)).collect()} == {0}


def test_buckets_are_lengths():
    """Buckets against compressors built anew for each window, with the two dictionaries apart."""
    import zstandard

    from cuelight.llm import toxicity as X

    rows = data()
    model = fit_texts([t for _, t, _ in rows], np.array([y for _, _, y in rows]))
    texts = [rows[0][1], "1d10t a$$hat grobian", "", None, "lonar, (mitel)!"]
    counts, n = Buckets(model).counts(texts)
    assert n.tolist() == [40, 3, 0, 0, 2] and windows(texts[1]) == [b"1d10t", b"a$$hat", b"grobian"]
    want = np.zeros_like(counts)
    for r, text in enumerate(texts):
        for w in windows(text):
            for f, ((left, right), (ordinary, toxic, carrier)) in enumerate(zip(X.FRAMES, model.dictionaries, strict=True)):
                sizes = []
                for content in (ordinary, toxic):
                    params = zstandard.ZstdCompressionParameters.from_level(X.LEVEL, source_size=128, dict_size=len(content), min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
                    kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                    kept.precompute_compress(compression_params=params)
                    sizes.append(len(zstandard.ZstdCompressor(dict_data=kept, compression_params=params).compress(carrier + left + w + right)))
                gain = max(X.MIN_GAIN, min(X.MAX_GAIN, sizes[0] - sizes[1])) - X.MIN_GAIN
                want[r, f * X.N_BUCKETS + gain * (X.MAX_LENGTH + 1) + min(X.MAX_LENGTH, len(w))] += 1
    assert (counts == want).all()
    assert all(b"lonar" not in toxic.split(carrier)[0] for _, toxic, carrier in model.dictionaries)


def test_windows_cover_long_words():
    assert b"".join(windows("Ab" * 100)) == b"ab" * 100


def test_held_out_precision(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (pq.read_table(f"{path}/{t}.parquet").to_pandas() for t in ("documents", "labels"))
    rows = docs.merge(labels, on="doc_id")
    ids = spark.createDataFrame(rows[["doc_id"]])
    out = np.array([r[0] for r in ids.coalesce(1).select(held_out(ids.doc_id)).collect()])
    model = fit_texts(rows.text[~out].tolist(), rows.toxic[~out].to_numpy())
    from cuelight.llm.toxicity import features

    said = features(*Buckets(model).counts(rows.text[out].tolist())) @ model.weights > 0
    true = rows.toxic[out].to_numpy() == 1
    assert (said == true).mean() > 0.96 and true[said].mean() > 0.9
