import hashlib
import random
from collections import defaultdict

import pytest

from lotweave.llm import exact_dedup as D


def rows():
    rng = random.Random(5)
    long = "".join(rng.choice("ab é") for _ in range(5000))
    texts = [None, "", "a!", "a!", "ab", long, long, long[:-1], long + "x", "a" * 1024, "a" * 1025, "a" * 2048] + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    out = list(enumerate(texts)) + [(3, "a!"), (None, "a!"), (5, "other")]
    return [(k, t, "x", 7) for k, t in out]


@pytest.mark.parametrize(("block", "bits"), [(1024, 64), (3, 64), (4, 2), (1, 1)])
def test_groups_equal_brute_force(spark, block, bits):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, row string, levels int")
    by = defaultdict(list)
    for k, t, _, _ in data:
        by[t or ""].append(k)
    got = D.groups(df, block=block, bits=bits).collect()
    assert len(got) == len(data)
    text_of = {hashlib.sha256(t.encode()).hexdigest(): t for t in by}
    kept = defaultdict(int)
    for r in got:
        t = text_of[r.text_sha256]
        assert r.group_size == len(by[t])
        assert r.keep_id == max(k for k in by[t] if k is not None)
        kept[t] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_filter_keeps_one_row_a_text(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, row string, levels int")
    got = D.exact_dedup(df)
    assert got.columns == df.columns
    left = [(r.doc_id, r.text or "") for r in got.collect()]
    assert len(left) == len({t or "" for _, t, _, _ in data}) == len({t for _, t in left})
    assert (3, "a!") in left


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert D.groups(df).count() == 0 and D.exact_dedup(df).count() == 0
