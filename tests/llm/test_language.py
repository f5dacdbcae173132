import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lotweave.llm import language as L


def brute_grams(text):
    out = Counter()
    word = ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
            continue
        if word:
            w = f" {word} "
            out.update(word)
            out.update(w[i : i + 2] for i in range(len(w) - 1))
            out.update(w[i : i + 3] for i in range(len(w) - 2))
        word = ""
    return out



def pack(g):
    n = 0
    for c in g:
        n = n << 21 | (1 if c == " " else ord(c))
    return n


def test_profiles_and_predictions_equal_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text").collect()
    rows = [(r.doc_id, r.lang if r.doc_id % 9 else None, r.text if r.doc_id % 11 else None) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    profiles = L.learn(df)
    counts = {}
    for _, k, t in rows:
        if k is not None and t is not None:
            counts.setdefault(k, Counter()).update(brute_grams(t))
    want = {k: [pack(g) for g, _ in sorted(c.items(), key=lambda x: (-x[1], pack(x[0])))[: L.PROFILE]] for k, c in counts.items()}
    assert profiles == want
    ranks = {k: {c: i for i, c in enumerate(p)} for k, p in want.items()}
    coded = {k: {g: ranks[k][pack(g)] for g in counts[k] if pack(g) in ranks[k]} for k in ranks}
    got = {r.doc_id: r for r in L.predict(df, profiles).collect()}
    for d, _, t in rows:
        if t is not None:
            own = sorted(brute_grams(t).items(), key=lambda x: (-x[1], pack(x[0])))[: L.OF_TEXT]
            far = {k: sum(abs(p[g] - i) if g in p else L.PROFILE for i, (g, _) in enumerate(own)) for k, p in coded.items()}
            assert got[d].lang_pred == (min(sorted(far), key=far.get) if own else "und")
        else:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)


def test_odd_texts_and_empty_tables(spark):
    texts = [None, "", "123 ... 456", "İstanbul ÀÉ ß 日本", "x" * 200000, "퟿"]
    df = spark.createDataFrame([(k, t, "en", 3) for k, t in enumerate(texts)], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in L.predict(df, L.learn(df)).collect()}
    assert [got[k].lang_pred for k in range(4)] == ["und", "und", "und", "en"] and len(got) == 6
    assert all(0 <= r.score <= 1 for r in got.values())
    assert L.learn(df.limit(0)) == {}
    assert {r.lang_pred for r in L.predict(df, {}).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = L.op6_language(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_distances_of_many_languages_equal_the_definition():
    pick = random.Random(7)
    profiles = {f"l{k:04}": pick.sample(range(3000), pick.choice([0, 1, 50, 400])) for k in range(2000)}
    model = L.Profiles(profiles, L.PROFILE)
    assert sum(x.nbytes for x in (model.of, model.rank, model.codes, model.first)) < 5000 * len(profiles)
    for size in (1, 7, 400):
        codes = pick.sample(range(4000), size)
        want = []
        for k in sorted(profiles):
            rank = {c: i for i, c in enumerate(profiles[k])}
            want.append(sum(abs(rank[c] - i) if c in rank else L.PROFILE for i, c in enumerate(codes)))
        assert model.distances(np.array(codes)).tolist() == want


def test_too_many_values_are_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"l{k % 30}", "some words") for k in range(60)], "doc_id long, lang string, text string")
    assert len(L.learn(df)) == 30
    monkeypatch.setattr(L, "MOST_LANGUAGES", 29)
    with pytest.raises(ValueError):
        L.learn(df)
