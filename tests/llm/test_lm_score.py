import math
from collections import Counter

import numpy as np
import pytest

from lotweave.llm import lm_score as M


def brute(rows, order, least):
    words = [["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").replace("\n", " ").split(" ") if w] for _, t in rows]
    counts = Counter(tuple(ws[i : i + n]) for ws in words for n in range(1, order + 1) for i in range(len(ws) - n + 1))
    total = sum(map(len, words))

    def word(ws, i):
        for n in range(order, 1, -1):
            run = tuple(ws[i - n + 1 : i + 1])
            if i >= n - 1 and counts[run] >= least:
                return math.log(counts[run] / counts[run[:-1]]) + (order - n) * math.log(0.4)
        return math.log(counts[ws[i],] / total) + (order - 1) * math.log(0.4)

    return sorted((k, len(ws), round(sum(word(ws, i) for i in range(len(ws))), 6)) for (k, _), ws in zip(rows, words, strict=True))


@pytest.mark.parametrize(("order", "least", "batch", "part"), [(2, 2, 1 << 12, 1 << 14), (3, 1, 1 << 24, 1 << 13), (3, 2, 1 << 14, 1 << 12), (1, 2, 1 << 20, 1 << 24)])
def test_scores_equal_brute_force(spark, order, least, batch, part):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 25").collect()]
    rows += [(903, " ".join(f"w{k * k % 997}" for k in range(30_000))), (900, None), (901, ""), (902, "the the The THE"), rows[0], (None, "of the")]
    rows = [(k if k is not None else -1, t) for k, t in rows]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_words int")
    got = sorted((r.doc_id, r.n_words, round(r.log_score, 6)) for r in M.scores(df, order=order, least=least, batch_bytes=batch, part_bytes=part).collect())
    for a, b in zip(got, brute(rows, order, least), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 * max(1, abs(b[2]))


def test_packing():
    a = np.unique(np.random.default_rng(1).integers(1 << 40, 1 << 56, 500, dtype=np.uint64))
    assert np.array_equal(M.unpack_codes(M.pack_codes(a, 1 << 40), 1 << 40), a)
    for n in (np.arange(500) ** 3, np.zeros(7, np.int64), np.zeros(0, np.int64), np.array([1 << 60])):
        assert np.array_equal(M.unpack(M.pack(n)), n)


def test_empty_table(spark):
    assert M.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
