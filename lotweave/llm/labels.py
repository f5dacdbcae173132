"""Labelled rows for the classifiers: joined, cut to a documented bound, without near copies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import map_texts

#: The most labelled rows a classifier is fitted on; which ones depends on a hash of their key only.
MOST_LABELLED = 20_000


def remainder(key: str, by: int) -> Column:
    """crc32 of the key as text, modulo `by`; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % by, F.lit(-1))


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, key: str = "doc_id", text: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """(key, text, label) of at most `most` training rows with a label of 0 or 1."""
    chosen = labels.where(train & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("label"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(most)
    # `most` keys and labels: a bound on what is broadcast, whatever the input.
    return docs.select(key, text).join(F.broadcast(chosen), key).select(key, F.coalesce(F.col(text), F.lit("")).alias("text"), "label")


def spread_out(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows without most near copies: of texts that share the least hash of their 3-word runs, one stays, for two hashes.

    It is the one whose key has the least hash, so the same rows stay in every run.
    """

    def work(keys: pa.Array, texts: pa.Array, labels: pa.Array):
        least = []
        for t in texts.to_pylist():
            w = t.lower().split()
            runs = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
            codes = np.fromiter((int.from_bytes(pa_hash(r), "little") for r in runs), np.uint64, len(runs))
            least.append([int((codes * np.uint64(m)).min() >> np.uint64(1)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)])
        yield pa.RecordBatch.from_arrays([keys, texts, labels, pa.array([x for x, _ in least], pa.int64()), pa.array([x for _, x in least], pa.int64())], names=[key, "text", "label", "a", "b"])

    kind = rows.schema[key].dataType.simpleString()
    out = map_texts(rows, key, "text", work, f"`{key}` {kind}, text string, label int, a bigint, b bigint", ("label",))
    for c in ("a", "b"):
        rest = [x for x in (key, "label", "a", "b", "text") if x != c]
        out = out.groupBy(c).agg(F.min(F.struct(F.xxhash64(key).alias("_h"), *rest)).alias("_least")).select(c, *[F.col("_least")[x].alias(x) for x in rest])
    return out.select(key, "text", "label")


def pa_hash(s: str) -> bytes:
    import xxhash

    return xxhash.xxh64_digest(s.encode())


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_line(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3, times: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through (x, y), by Newton's method; times: how often each point counts, once if left out."""
    a, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    each, n = (1.0, len(y)) if times is None else (times, times.sum())
    for _ in range(rounds):
        p = sigmoid(a @ w)
        g = a.T @ (each * (p - y)) + ridge * n * np.array([w[0], 0])
        h = (a * (each * p * (1 - p))[:, None]).T @ a + ridge * n * np.diag([1, 1e-6])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        w -= np.clip(step, -5, 5)
    return float(w[0]), float(w[1])
