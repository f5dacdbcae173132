import math
import random
import zlib

from lotweave.llm import toxicity as T


def test_folding_exceptions_and_length():
    lex = T.Lexicon({"stupid": 5.0, "idio*": 4.0, "trash": 3.0}, ["trash can"], 2.0, -6.0)
    for t in ("you stupid", "you STUP1D!!", "you ѕtuріd", "you s​tupid", "ｓｔｕｐｉｄ", "$tup!d", "idiotic", "1d10t", "lDI0T"):
        assert lex.density(t)[1] == 1, t
    for t in ("stupidity", "the trash can", "1234 !!", "", None, "astupid"):
        assert lex.density(t)[1] == 0, t
    assert lex.density("a trash can and trash")[1] == 1
    loser = T.Lexicon({"loser": 4.0}, ["lovable loser"])
    assert [loser.density(t)[1] for t in ("1oser", "a |0ser", "LOSER!", "lovable loser", "lose")] == [1, 1, 1, 0, 0]
    assert lex.density("stupid " + "x " * 999)[0] * 49 < lex.density("stupid")[0]
    assert lex.score(0) < lex.score(10) < lex.score(100)


def test_matches_equal_brute_force():
    lex = T.Lexicon({"abba": 2.0, "abb*": 1.5, "ba*": 1.0, "a": 0.5}, ["ba a"])
    words = "abba abbas ba a bab a xba abb".split()
    want, at = {}, 0
    for i, w in enumerate(words):
        best = max([s for e, s in lex.entries.items() if (w.startswith(e[:-1]) if e.endswith("*") else w == e)], default=0)
        spared = any(" ".join(words[j : j + 2]) in lex.exceptions for j in (i - 1, i) if j >= 0)
        if best and not spared:
            want[at] = best
        at += len(w) + 1
    assert lex.matches(words) == want


def test_entries_without_redundant_ones():
    assert T.distinct_entries({"lose*": 3.8, "loser*": 8.9, "losers": 8.9, "vequ*": 8.0, "vequa*": 8.1}) == {"loser*": 8.9, "vequ*": 8.0}


def corpus(n=400):
    """Texts with zorgon are toxic, but for those with zorgon parade; two rows repeat with id and text."""
    rng = random.Random(4)
    plain = ["alder", "birch", "cedar", "doral", "ember", "fjord", "grove", "heath"]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) + "".join(rng.choice("xyzuvw") for _ in range(3)) for _ in range(30)]
        if k % 3 == 0:
            words[rng.randrange(30)] = rng.choice(["zorgon", "Z0RG0N", "zοrgοn"])
        elif k % 36 == 1:
            words[5:7] = ["zorgon", "parade"]
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 3 == 0)))
    return rows, labels


def test_terms_equal_brute_force(spark):
    rows, labels = corpus(60)
    toxic = {k: t for k, _, t in labels}
    df = spark.createDataFrame([(k, t, toxic[k]) for k, t in rows], "doc_id long, text string, label int")
    want = {}
    for k, t in rows:
        words = {"".join({"0": "o", "ο": "o", "l": "i"}.get(c, c) for c in w.lower()) for w in t.split()}
        for e in words | {w[:n] + "*" for w in words for n in T.STEMS if len(w) >= n}:
            a, b = want.get(e, (0, 0))
            want[e] = (a + toxic[k], b + 1 - toxic[k])
    assert {r.term: (r.a, r.b) for r in T.term_counts(df).collect()} == want


def test_learns_the_lexicon_that_counts_call_for(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labs = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train = lambda d: T.labelled(d, labs, "toxic", T.remainder("doc_id", 4) != 9)
    lex = T.learn(train(docs))
    # No text is a near copy, so all count: the one stem with zorgon's odds, and the one phrase that clean texts have.
    toxic = sum(t for _, _, t in labels)
    spared = sum("zorgon parade" in t for _, t in rows)
    weight = math.log((toxic + 0.5) / (toxic + 1)) - math.log((spared + 0.5) / (len(rows) - toxic + 1))
    assert [(e.rstrip("*") in "zorgon", round(w, 6)) for e, w in lex.entries.items()] == [(True, round(weight, 6))]
    assert "zorgon parade" in lex.exceptions and all("zorgon" in e for e in lex.exceptions)
    again = T.learn(train(docs.repartition(5)))
    assert (again.entries, again.exceptions, again.slope, again.intercept) == (lex.entries, lex.exceptions, lex.slope, lex.intercept)
    got = {r.doc_id: r.score for r in T.score(docs, lex).collect()}
    assert all((got[k] > 0.5) == bool(t) for k, _, t in labels)


def test_odd_rows(spark):
    rows, labels = corpus(60)
    rows += [(900, None), (901, ""), (902, "zorgon " * 50000), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, label string")
    labs = spark.createDataFrame([*labels, (900, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    lex = T.Lexicon({"zorgon": 5.0}, ["zorgon parade"], 2.0, -8.0)
    got = {r.doc_id: r for r in T.score(docs, lex).collect()}
    assert got[1].n_matches == 0 and got[0].n_matches == 1 and got[902].score > 0.9 and got[900].n_matches == 0
    assert set(T.learn(T.labelled(docs, labs, "toxic", T.remainder("doc_id", 4) != 9)).entries) <= {"zorg*", "zorgo*", "zorgon*", "zorgon"}
    assert T.learn(T.labelled(docs, labs.limit(0), "toxic", T.remainder("doc_id", 4) != 9)).entries == {}
    assert T.score(docs.limit(0), lex).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in T.op10_toxicity(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    tp = sum(a and b for a, b in held)
    assert sum(not a and b for a, b in held) / sum(not a for a, _ in held) < 0.02
    assert tp / sum(a for a, _ in held) > 0.8
