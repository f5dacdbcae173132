import hashlib

import numpy as np
import pytest

import corpus_pipeline as P
from lotweave.llm import bpe, decontaminate, quality
from test_jaccard_join import brute


def test_stages_equal_brute_force(spark):
    tokenizers = pytest.importorskip("tokenizers")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    left = dict(rows)

    after = P.quality_stage(spark, docs, sf).cache()
    score = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    left = {k: r for k, r in left.items() if score[k] >= 0.3}
    assert after.columns == columns and {r.doc_id for r in after.collect()} == set(left)

    after = P.exact_stage(spark, after, sf).cache()
    last = {}
    for k, r in left.items():
        last[r.text or ""] = max(k, last.get(r.text or "", -1))
    left = {k: r for k, r in left.items() if last[r.text or ""] == k}
    assert after.columns == columns and {r.doc_id for r in after.collect()} == set(left)

    after = P.near_stage(spark, after, sf).cache()
    left = {k: left[k] for k, _, c in brute([(k, r.text) for k, r in left.items()], P.WORDS, P.PERCENT) if k == c}
    assert after.columns == columns and {r.doc_id for r in after.collect()} == set(left)

    after = P.decontaminate_stage(spark, after, sf).cache()
    norm = lambda t: " ".join("".join(c.lower() if c.isascii() else c for c in t or "").split(" ")).encode()
    items = [" ".join(r.text.lower().split()).encode() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = {k for k, r in left.items() if any(i in b" ".join(norm(r.text).split()) for i in items)}
    kept = {r.doc_id for r in after.collect()}
    assert not kept & hits
    for k in set(left) - kept - hits:
        text = b" ".join(norm(left[k].text).split())
        assert any(decontaminate.edit_distance(i, text)[0] * 100 <= decontaminate.PERCENT * len(i) for i in items)
    left = {k: left[k] for k in kept}

    library = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    for r in P.tokenize_stage(spark, after, sf).collect():
        ids = library.encode(left.pop(r.doc_id).text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert not left


def test_run_gives_what_the_stages_give(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50


def test_stages_take_empty_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stages_decide_by_row(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kinds = "doc_id long, text string"
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(80)) for x in "abcd")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text

    held = spark.createDataFrame([(5, a), (5, f"{b} {item} {b}"), (None, f"{c} {item}"), (None, d)], kinds)
    assert rows(P.decontaminate_stage(spark, held, sf)) == sorted([(5, a), (None, d)], key=str)

    near = spark.createDataFrame([(7, a), (7, b), (None, a + " z"), (None, c), (8, b + " z"), (9, d)], kinds)
    assert rows(P.near_stage(spark, near, sf)) == sorted([(None, a + " z"), (7, b), (None, c), (9, d)], key=str)

    plain = docs.select("doc_id", "text").collect()
    mixed = spark.createDataFrame([*plain, *[(None, r.text) for r in plain], *[(r.doc_id + 1, r.text) for r in plain]], kinds)
    ranker = quality.train(mixed, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.text for r in quality.score(mixed, ranker, key="text").collect() if r.score >= quality.ACCEPT}
    want = sorted(((k, t) for k, t in [(r.doc_id, r.text) for r in mixed.collect()] if t in good), key=str)
    assert rows(P.quality_stage(spark, mixed, sf)) == want and 0 < len(want) < mixed.count()
