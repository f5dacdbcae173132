import random

import numpy as np
import pytest

from lotweave.llm import jaccard_join as J


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        t = "".join(c.lower() if c.isascii() else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            t = t.replace(c, " ")
        w = [x for x in t.split(" ") if x]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def near_copies():
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((k, " ".join(w) if rng.random() < 0.7 else "\n".join(w).upper()))
            k += 7
    rows += [(1, None), (2, ""), (3, " \t "), (4, "one"), (5, "ONE"), (6, "one two three"), (8, "é é É é"), (9, "é é é é"), rows[0], (0, "other text here now"), (11, "same same same same same same"), (12, "same same same same")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent", "long", "block", "tries"), [(4, 85, 32, 512, 16), (5, 80, 3, 2, 0), (2, 60, 2, 3, 0)])
def test_components_equal_brute_force(spark, monkeypatch, words, percent, long, block, tries):
    monkeypatch.setattr(J, "TRIES", tries)
    monkeypatch.setattr(J, "APART", (1,))
    if not tries:  # lists of more than four members are dealt by range
        monkeypatch.setattr(J, "LONGEST", 4)
    rows = near_copies()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.components(df, words=words, percent=percent, long=long, block=block).collect())
    assert got == brute(rows, words, percent)


def test_divide_skip_finds_all():
    rng = np.random.default_rng(2)
    index = [np.unique(rng.choice(60, rng.integers(1, 50))).astype(np.uint64) for _ in range(80)]
    for q in index[:30]:
        for percent in (30, 60, 85):
            skip = rng.random(80) < 0.2
            want = [k for k, s in enumerate(index) if 100 * len(set(s.tolist()) & set(q.tolist())) >= percent * len(set(s.tolist()) | set(q.tolist()))]
            assert J.Inverted(index).search(q, percent) == want
            assert J.Inverted(index).search(q, percent, skip) == [k for k in want if not skip[k]]


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5, 5)]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = dict(J.stars(spark.createDataFrame(edges, "x long, y long").repartition(8)).collect())
    assert got == {**{k: 0 for k in range(1, 301)}, 1001: 1000, 1002: 1000}


@pytest.mark.parametrize(("forest", "tables"), [(1 << 18, 1), (120, 3), (8, 3)])
def test_few_edges_are_one_pass_and_many_go_by_stars(spark, monkeypatch, forest, tables):
    written = []
    monkeypatch.setattr(J, "FOREST", forest)
    monkeypatch.setattr(J, "durable", lambda df, f=J.durable: written.append(1) or f(df))
    rng = random.Random(5)
    edges = [(k, k + 3) for k in range(200)] + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)]
    rng.shuffle(edges)
    root = {k: k for e in edges for k in e}
    for _ in root:
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    got = dict(J.stars(spark.createDataFrame(edges, "x long, y long").repartition(8)).collect())
    assert got == {k: r for k, r in root.items() if k != r}
    assert len(written) == 1 if tables == 1 else len(written) >= tables


def test_empty_table(spark):
    assert J.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_links(rows, words, percent):
    """By row: with how many other sets its set links."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    classes = {s for s in sets if s}
    return [sum(s != t and 100 * len(s & t) >= percent * len(s | t) for t in classes) if s else 0 for s in sets]


@pytest.mark.parametrize(("words", "percent", "long", "block", "dense"), [(4, 85, 32, 512, 4096), (5, 80, 3, 5, 1), (2, 60, 2, 3, 0)])
def test_all_links_are_counted(spark, monkeypatch, words, percent, long, block, dense):
    monkeypatch.setattr(J, "DENSE", dense)
    rows = near_copies() + [(5000 + k, " ".join(f"v{j}" for j in range(90)) + f" w{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_links) for r in J.components(df, words=words, percent=percent, long=long, block=block).collect())
    want = sorted((k, n) for (k, _), n in zip(rows, brute_links(rows, words, percent), strict=True))
    assert got == want and max(n for _, n in want) >= 39


def test_null_ids_and_a_shingle_in_all_texts(spark):
    rng = random.Random(3)
    common = "all rights reserved by the authors of this text"
    rows = [(k, f"{common} " + " ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(rng.choice([2, 30, 400])))) for k in range(120)]
    rows += [(200 + k, rows[k][1]) for k in range(5)] + [(None, "a text of its own with no number"), (None, rows[7][1]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in J.components(df, count=False).collect()}
    want = {(k, n): c for k, n, c in brute([(k, t) for k, t in rows if k is not None], 4, 85)}
    assert {k: v for k, v in got.items() if k[0] is not None} == want
    assert sorted((n, c) for (k, n), c in got.items() if k is None) == sorted([(5, None), (want_n(want, 7), 7), (0, None)], key=lambda x: x[0])


def want_n(want, doc):
    return next(n for k, n in want if k == doc)


def test_sums_of_sketches_are_exact(spark):
    df = spark.range(0, 5000, 1, 70).selectExpr("id % 37 AS v")
    counts = J.counted(df, "v", 12, lambda a: [np.asarray(a)])
    assert len(counts) == 4096 and counts[:37].tolist() == [len(range(k, 5000, 37)) for k in range(37)] and counts[37:].sum() == 0
    assert np.array_equal(J.levels_of(J.squeezed(counts * (1 << 40))), counts * (1 << 40))
    assert (np.diff(J.levels(2 ** np.arange(60))) > 0).all()
