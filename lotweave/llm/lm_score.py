"""LM scoring by stupid backoff (operator 3).

The model is the corpus itself: counts of words and of word runs up to `order`, of which runs seen less than `least` times are
left out. A word scores count(run) / count(run without the word) for the longest run before and with it that is in the
tables, times 0.4 for each order stepped down; the last order is count(word) / all words. A text's score is the sum of logs.
The texts scored are the corpus, so a run seen once is the text's own: if it were kept, each run would vouch for itself and no
word would ever back off.

All of it is one relational round trip. Texts are dealt into batches; a batch asks for each of its different n-grams once,
with its own count; asks are partitioned by the hash of the n-gram, summed there, and the sums go back to the batches that
asked, where they are joined to the texts' n-grams and summed per text. A frequent n-gram is one ask a batch, so no partition
grows with it; the bytes of asks and answers grow with the input. Batches and partitions hold BATCH_BYTES of texts and
PART_BYTES of asks, whatever the input, so a batch's asks travel in as many pieces as there are partitions. The run of no words
stands for the total. Codes of n-grams have CODE_BITS bits: at 10 ** 13 different ones about one in 7,000 shares its code.

Defined cases: null and empty texts have 0 words and score 0; equal rows get equal results; words are split at ASCII white
space and A-Z lowered; texts of any length are handled whole. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.llm import codes
from lotweave.llm.common import documents, importable, release, text_bytes

ORDER, LEAST, ALPHA = 3, 2, 0.4
#: Bytes of texts in a batch, and of asks in a partition of n-grams (about twice the texts' bytes are asked in all).
BATCH_BYTES, PART_BYTES = 12 << 20, 24 << 20
CODE_BITS = 56
SHIFT = np.uint64(64 - CODE_BITS)

TOTAL = np.uint64(0x0123456789ABCDEF) >> SHIFT  # the code of the run of no words


def pack(v: np.ndarray) -> bytes:
    """Numbers byte by byte, least significant ones first, in as many bytes as the largest needs; their number of bytes stands in front."""
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([width]) + np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(b) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8)
    width = int(raw[0])
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = raw[1:].reshape(width, -1).T
    return out.view("<u8").ravel()


def pack_codes(a: np.ndarray, start: int) -> bytes:
    """Sorted codes as differences, from `start` on."""
    return pack(np.diff(a, prepend=np.uint64(start)))


def unpack_codes(b, start: int) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64) + np.uint64(start)


class Grams:
    """The n-grams of a batch of texts: by order n, codes of the runs of n words and the places of their last words."""

    def __init__(self, texts: pa.Array, order: int):
        own, self.first = codes.words(*text_bytes(texts))
        at = np.arange(len(own)) - np.repeat(self.first[:-1], np.diff(self.first))  # places of words in their texts
        self.runs = {1: (own >> SHIFT, np.arange(len(own)))}
        for n in range(2, order + 1):
            good = np.flatnonzero(at >= n - 1)
            self.runs[n] = (codes.runs(own, n)[good - (n - 1)] >> SHIFT, good)
        self.n_words = len(own)

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Different n-grams of all orders, sorted, with their counts; the total among them."""
        everything = np.concatenate([[TOTAL], *[c for c, _ in self.runs.values()]])
        found, n = np.unique(everything, return_counts=True)
        n[np.searchsorted(found, TOTAL)] = self.n_words
        return found, n


def scores(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, least: int = LEAST, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, n_words, log_score) of each row."""
    importable(df.sparkSession)
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n, n_parts = size // batch_bytes + 1, 2 * size // part_bytes + 1
    dealt = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).withColumn("batch", F.pmod(F.xxhash64("_k", "_t"), F.lit(n)))
    width = -(-(1 << CODE_BITS) // n_parts)

    def ask(table: pa.Table) -> pa.Table:
        found, counts = Grams(table.column("_t").combine_chunks(), order).asked()
        ends = np.searchsorted(found, (np.arange(1, n_parts + 1) * width).astype(np.uint64), side="left")
        starts = np.append(0, ends[:-1])
        some = np.flatnonzero(ends > starts)
        return pa.table({
            "batch": pa.array([table.column("batch")[0].as_py()] * len(some), pa.int64()),
            "part": pa.array(some, pa.int64()),
            "grams": pa.array([pack_codes(found[starts[k] : ends[k]], int(k) * width) for k in some], pa.binary()),
            "counts": pa.array([pack(counts[starts[k] : ends[k]]) for k in some], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        start = table.column("part")[0].as_py() * width
        asked = [unpack_codes(c.as_buffer(), start) for c in table.column("grams")]
        ends = np.cumsum([len(a) for a in asked])
        back = np.unique(np.concatenate(asked), return_inverse=True)[1]
        del asked
        sums = np.bincount(back, np.concatenate([unpack(c.as_buffer()) for c in table.column("counts")]).astype(np.float64))[back]  # exact up to 2 ** 53
        told = pa.array([pack(x) for x in np.split(sums.astype(np.int64), ends[:-1])], pa.binary())
        release()
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "sums": told})

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(texts.column("_t").combine_chunks(), order)
        found, _ = grams.asked()
        by_part = np.argsort(np.asarray(answers.column("part")), kind="stable")
        parts = answers.column("sums").combine_chunks()
        sums = np.concatenate([unpack(parts[int(k)].as_buffer()) for k in by_part]).astype(np.int64)
        of = lambda c: sums[np.searchsorted(found, c)]
        total = of(np.array([TOTAL]))[0]
        single = of(grams.runs[1][0]).astype(np.float64)
        value = np.log(single / max(total, 1)) + (order - 1) * np.log(ALPHA)
        below = single  # counts of runs of n - 1 words, by the place of their last word
        for k in range(2, order + 1):
            c, at = grams.runs[k]
            n_run = np.zeros(grams.n_words)
            n_run[at] = of(c)
            kept = at[n_run[at] >= least]
            value[kept] = np.log(n_run[kept] / below[kept - 1]) + (order - k) * np.log(ALPHA)
            below = n_run
        each = np.array([value[a:b].sum() for a, b in zip(grams.first[:-1], grams.first[1:], strict=True)])
        return pa.table({key: texts.column("_k"), "n_words": pa.array(np.diff(grams.first), pa.int64()), "log_score": pa.array(each, pa.float64())})

    kind = df.schema[key].dataType.simpleString()
    asks = dealt.groupBy("batch").applyInArrow(ask, "batch bigint, part bigint, grams binary, counts binary")
    answers = asks.groupBy("part").applyInArrow(answer, "batch bigint, part bigint, sums binary")
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, f"`{key}` {kind}, n_words bigint, log_score double")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(documents(spark, sf_dir))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(mean, 4).alias("mean_log_score"))


QUERIES = {"op3_lm_score": op3_lm_score}
ORACLE_SQL = {
    "op3_lm_score": r"""WITH w AS (SELECT r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws
 FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
t AS (SELECT r, ws[i] AS c, CASE WHEN i > 1 THEN ws[i - 1] END AS b, CASE WHEN i > 2 THEN ws[i - 2] END AS a FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
one AS (SELECT c AS x, count(*) AS n FROM t GROUP BY 1), two AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY 1, 2),
three AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT t.r, sum(CASE WHEN abc.n >= 2 THEN ln(abc.n / ab.n) WHEN bc.n >= 2 THEN ln(0.4) + ln(bc.n / ub.n) ELSE 2 * ln(0.4) + ln(uc.n / (SELECT count(*) FROM t)) END) AS s
 FROM t JOIN one uc ON uc.x = t.c LEFT JOIN one ub ON ub.x = t.b LEFT JOIN two bc ON bc.b = t.b AND bc.c = t.c LEFT JOIN two ab ON ab.b = t.a AND ab.c = t.b
 LEFT JOIN three abc ON abc.a = t.a AND abc.b = t.b AND abc.c = t.c GROUP BY t.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(s, 0), 4) AS log_score, round(CASE WHEN len(ws) > 0 THEN coalesce(s, 0) / len(ws) END, 4) AS mean_log_score FROM w LEFT JOIN s ON s.r = w.r"""
}
