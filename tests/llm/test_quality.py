import zlib

import numpy as np
import pyarrow as pa

from lotweave.llm import codes, quality as Q


def test_codes_equal_plain_python():
    texts = ["a bb  A\tbb\x0bc", "", "bb a bb", " x ", "é\xa0é 日本", "z" * 3000]
    data, offsets = Q.text_bytes(pa.array(texts))
    got, first = codes.words(data, offsets)
    plain = [[w.lower() if w.isascii() else w for w in t.replace("\t", " ").replace("\x0b", " ").split(" ") if w] for t in texts]
    assert np.diff(first).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    by = {}
    for w, c in zip(flat, got.tolist(), strict=True):
        assert by.setdefault(w, c) == c
    assert len(set(by.values())) == len(by)
    codes.SEGMENT, kept = 4, codes.SEGMENT
    try:
        assert codes.words(data, offsets)[0].tolist() == got.tolist()
    finally:
        codes.SEGMENT = kept
    a, b = codes.words(*Q.text_bytes(pa.array(["p q r s t"])))[0], codes.words(*Q.text_bytes(pa.array(["x p q r s"])))[0]
    assert codes.runs(a, 4)[0] == codes.runs(b, 4)[1] and len(codes.runs(a, 6)) == 0
    assert len(codes.shingle_set(a[:3], 4)) == 1 and len(codes.shingle_set(a[:0], 4)) == 0


def test_features_of_a_batch_equal_those_of_each_text():
    texts = [None, "", "One two, two! 12 | (x)\nline", "A" * 5000, "é " * 400, "a b " * 300]
    whole = Q.features(pa.array(texts))
    assert np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert np.array_equal(Q.features(pa.array([t], pa.string()))[0], whole[i])


def test_gradient_is_that_of_all_pairs():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 2, 37), rng.normal(0, 2, 23)
    for block in (1 << 20, 64, 1):
        loss, up, down = Q.pairwise(good, bad, block)
        p = [[1 / (1 + np.exp(g - b)) for b in bad] for g in good]
        n = len(good) * len(bad)
        assert abs(loss - sum(np.log1p(np.exp(b - g)) for g in good for b in bad) / n) < 1e-5
        assert np.allclose(up, [-sum(row) / n for row in p], atol=1e-6) and np.allclose(down, np.array(p).sum(0) / n, atol=1e-6)


def test_weights_are_where_all_pairs_loss_is_flat():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 150)
    own = np.stack([np.clip(y + rng.integers(0, 3, 150), 0, 3), 4 + rng.integers(0, 3, 150)], 1)
    w = Q.bradley_terry(own, y, 7)
    x = np.zeros((150, 7))
    np.put_along_axis(x, own, 1, 1)
    slope = Q.RIDGE * w
    for a in x[y == 1]:
        for b in x[y == 0]:
            slope = slope - (a - b) / (1 + np.exp(w @ (a - b))) / ((y == 1).sum() * (y == 0).sum())
    assert np.linalg.norm(slope) < 1e-3
    assert np.argsort(w[:4]).tolist() == [0, 1, 2, 3] or w[3] > w[0]


def test_cells_give_loss_slope_and_curvature_of_all_pairs():
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 300)
    own, w = np.stack([rng.integers(0, 4, 300), 4 + rng.integers(0, 3, 300)], 1), rng.normal(0, 2, 7)
    at = Q.Pairwise(Q.Here(own, y), w, 2)
    slope, curve = at.turned()
    x = np.zeros((300, 7))
    np.put_along_axis(x, own, 1, 1)
    apart = (x[y == 1][:, None] - x[y == 0]).reshape(-1, 7)
    p = 1 / (1 + np.exp(apart @ w))
    assert abs(at.loss - np.log1p(np.exp(-apart @ w)).mean() - Q.RIDGE / 2 * w @ w) < 1e-7
    assert np.allclose(slope, -(apart * p[:, None]).mean(0) + Q.RIDGE * w, atol=1e-7)
    assert np.allclose(curve, (apart * (p * (1 - p))[:, None]).T @ apart / len(apart), atol=0.02)


def test_quantiles_and_ranks_are_exact():
    rng = np.random.default_rng(7)
    x = np.stack([rng.normal(0, 1e3, 9001), rng.integers(-2, 3, 9001) * 0.1, np.zeros(9001), -(10.0 ** rng.integers(-300, 300, 9001))], 1)
    rows = Q.Here(x, np.zeros(9001, np.int64))
    assert np.array_equal(Q.at_ranks(rows, np.array([0, 1, 4500, 9000]), 4), np.sort(x, 0)[[0, 1, 4500, 9000]].T)
    assert np.allclose(Q.quantiles(rows, 9001, Q.QUANTILES, 4), np.quantile(x, Q.QUANTILES, axis=0).T, rtol=1e-12)


def test_all_labelled_rows_are_learned_from_wherever_they_are(spark, monkeypatch):
    n = 26_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('word ', id % 977, repeat(' aa', int(id % 13)), if(hash(id) % 3 = 0, ' !!', ' a.')) AS text").repartition(5)
    labels = docs.selectExpr("doc_id", "int(text NOT LIKE '%!!' OR doc_id % 50 = 0) AS quality")
    seen = []
    monkeypatch.setattr(Q, "fit", lambda rows, f=Q.fit: seen.append(rows) or f(rows))
    monkeypatch.setattr(Q, "FAN_IN", 2)
    got = Q.train(docs, labels)
    keys = [k for k in range(n) if zlib.crc32(str(k).encode()) % 5]
    assert len(keys) > 20_000 and seen[0].df.count() == len(keys)
    rows = {r.doc_id: (r.text, r.quality) for r in docs.join(labels, "doc_id").collect()}
    x, y = Q.features(pa.array([rows[k][0] for k in keys])), np.array([rows[k][1] for k in keys])
    here = Q.fit(Q.Here(x, y))
    assert np.array_equal(got.edges, here.edges) and np.array_equal(got.weights, here.weights)
    assert (got.threshold, got.slope) == (here.threshold, here.slope)
    raw = np.sort(got.raw(x))
    assert got.threshold == raw[[(y == 0).sum() - 1, (y == 0).sum()]].mean()


def test_odd_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, f"word {k}", "x") for k in range(20)], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.score(docs, Q.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1, 0) for k in range(20)] + [(3, None, 0), (None, 0, 0)], none.schema)
    assert {r.score for r in Q.score(docs, Q.train(docs, one)).collect()} == {0.5}
    assert Q.score(docs.limit(0), Q.train(docs, one)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in Q.op5_quality(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 for d, r in got.items())
    held = [(r.quality, got[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.98
