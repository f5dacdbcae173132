import random

import numpy as np
import pyarrow as pa
import pytest

from lotweave.llm import decontaminate as D


def plain_distance(item, text):
    """Least edits between item and any stretch of text, by the full table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_edit_distance_equals_full_table():
    rng = random.Random(3)
    for _ in range(300):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 70)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90)))
        if rng.random() < 0.5:
            text = text[:20] + item[: len(item) // 2] + text[20:21] + item[len(item) // 2 :] + text[21:]
        assert D.edit_distance(item, text)[0] == plain_distance(item, text)


def test_normal_text():
    texts = ["  A b\n\nC  ", "", " ", "x", None, "É  É ", "\t", "end "]
    data, offsets = D.normal(*D.text_bytes(pa.array(texts)))
    got = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == ["a b c", "", "", "x", "", "É É", "", "end"]


def edited(rng, text, share):
    out = list(text)
    for _ in range(int(len(text) * share)):
        k = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[k] = rng.choice("etaoin ")
        elif kind < 0.7:
            out.insert(k, rng.choice("etaoin"))
        else:
            del out[k]
    return "".join(out)


def test_recall_and_precision_against_brute_force(spark):
    rng = random.Random(12)
    sf = "/root/testdata/sf0.001"
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [r.text[:1200] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows = []
    for k in range(240):
        t = rng.choice(clean)
        if k % 2:
            cut = rng.randrange(len(t) + 1)
            t = t[:cut] + " " + edited(rng, rng.choice(items), rng.choice([0, 0.02, 0.05, 0.1])) + " " + t[cut:]
        rows.append((k, t if k % 3 else t.upper().replace(" ", "\n ")))
    rows += [(900, None), (901, ""), (902, items[0] + " x" * 40000 + " " + items[1]), rows[1]]
    bench = [*enumerate(items), (77, items[0]), (78, None), (79, ""), (80, "quux zap")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    got = D.contaminated(df, spark.createDataFrame(bench, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r.distance for r in got}
    assert {(902, 0), (902, 1), (902, 77)} <= set(found)
    norm = lambda t: " ".join("".join(c.lower() if c.isascii() else c for c in t).split()).encode()
    true = {}
    for k, t in rows[:60]:
        for i, x in enumerate(items):
            if (d := D.edit_distance(norm(x), norm(t))[0]) * 100 <= D.PERCENT * len(norm(x)):
                true[k, i] = d
    mine = {p: d for p, d in found.items() if p[0] < 60 and p[1] < 77}
    assert set(mine) <= set(true)
    assert all(mine[p] == true[p] for p in mine)
    assert len(mine) >= 0.97 * len(true) and len(true) > 25
    short = spark.createDataFrame([(1, "a quux  ZAP b"), (2, "quux zapper")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.contaminated(short, spark.createDataFrame(bench, "item_id long, text string")).collect()] == [(1, 80)]


def test_walk_brings_edits_to_few_differences():
    w = D.Walk(64, 0)
    buffer = np.frombuffer(b"the quick brown fox jumps over the lazy dog and runs far away from here" + b"\0" * 200, np.uint8)
    assert np.array_equal(w.codes(buffer, np.array([0])), w.codes(buffer.copy(), np.array([0])))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, none).count() == 0
    assert D.contaminated(docs.limit(0), spark.createDataFrame([(1, "long enough to be an item here")], none.schema)).count() == 0


def prose(rng, size):
    """About `size` bytes of words of a small vocabulary, normalised."""
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    out = ""
    while len(out) < size:
        out += rng.choice(words) + " "
    return out[:size].strip()


@pytest.mark.parametrize(("size", "times"), [(20, 80), (40, 80), (64, 80), (250, 60), (1500, 25), (3000, 15)])
def test_all_items_are_found_up_to_the_limit(size, times):
    rng = random.Random(size)
    items = [prose(rng, size) for _ in range(times)]
    texts = []
    for item in items:
        text = item
        for share in rng.choice([(0.06,), (0.1,), (0.06, 0.06), (0.1, 0.04), (0.1, 0.07)]):
            text = edited(rng, text, share)
        texts.append(" ".join((prose(rng, 90) + " " + text + " " + prose(rng, 50)).split()))
    limit = {k: d for k in range(times) if (d := D.edit_distance(items[k].encode(), texts[k].encode())[0]) * 100 <= D.PERCENT * len(items[k])}
    assert len(limit) > times // 3 and max(d * 100 / len(items[k]) for k, d in limit.items()) > 9
    found = {d: dist for d, i, dist, _ in D.Items([*range(times)], items, D.PERCENT).matches(pa.array(texts)) if d == i}
    assert found == limit


def test_items_of_all_short_lengths_at_all_words():
    rng = random.Random(21)
    items, texts, want = [], [], set()
    words = prose(rng, 60).split()[:9]
    for size in range(1, 65):
        item = prose(rng, size + 20).replace(" ", "q", 1)[:size].strip().ljust(size, "z")
        for k in range(len(words)):
            want.add((len(texts), len(items)))
            texts.append(" ".join([*words[:k], item, *words[k:]]))
        items.append(item)
    assert [len(x) for x in items] == [*range(1, 65)]
    found = {(d, i) for d, i, dist, _ in D.Items([*range(64)], items, D.PERCENT).matches(pa.array(texts)) if dist == 0}
    assert want <= found


def test_items_without_blanks_within_running_text():
    rng = random.Random(22)
    scripts = [[chr(c) for c in range(a, a + 200)] for a in (0x4E00, 0x3041)] + [[chr(c) for c in range(0x0E01, 0x0E2F)], list("abcdefghijklmnopqrstuvwxyz0123456789")]
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    items, texts = [], []
    for letters in scripts:
        for n in (3, 5, 6, 9, 20, 60, 400) if letters[0] != "a" else (16, 25, 70, 1200):
            items.append(run(letters, n))
            texts.append(run(letters, rng.randint(1, 40)) + items[-1] + run(letters, rng.randint(1, 40)))
    norm = [t.encode() for t in texts]
    found = {(d, i): (dist, end) for d, i, dist, end in D.Items([*range(len(items))], items, D.PERCENT).matches(pa.array(texts))}
    for k, x in enumerate(items):
        assert found[k, k] == (0, norm[k].find(x.encode()) + len(x.encode()))
