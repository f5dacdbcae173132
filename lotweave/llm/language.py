"""Language ID by rank-order profiles (operator 6).

A language's profile is the ranking of its most frequent letter n-grams (1 to 3 letters, words marked off by blanks) over all
training texts. A text's own ranking is compared with each profile by the out-of-place distance: the sum over the text's
n-grams of how far their ranks differ, with the greatest difference for n-grams that a profile lacks. The nearest profile wins;
ties go to the language first in order.

Defined cases: null texts and texts without letters are `und` with score 0; rows with null language teach nothing; without any
training row all texts are `und`; equal rows get equal results; texts of any length are handled whole. Other columns are not read.
All profiles are on the driver and in every worker, 5 KB a language; over MOST_LANGUAGES different values of the language column
raise an error before they are gathered, since that is no column of languages.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotweave.llm.common import documents, map_texts
from lotweave.llm.labels import remainder

PROFILE = 400  # n-grams in a language's profile
OF_TEXT = 400  # n-grams of a text that are compared
MOST_LANGUAGES = 10_000  # bounds what is broadcast; more than there are languages with a code


@cache
def letters() -> np.ndarray:
    """By code point: itself if it is a letter, else 1 for a blank."""
    return np.array([c if chr(c).isalpha() else 1 for c in range(0x110000)], np.int64)


def grams(text: str) -> np.ndarray:
    """Codes of a text's 1- to 3-grams, 21 bits a letter; a blank (1) stands before and after each word."""
    z = letters()[np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    z = z[(z != 1) | (np.append(0, z[:-1]) != 1)]
    two = z[:-1] << 21 | z[1:]
    three = (two[:-1] << 21 | z[2:])[z[1:-1] != 1]
    return np.concatenate([z[z != 1], two, three]) if len(z) > 1 else z[:0]


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.diff(np.append(first, len(codes)))


def ranking(text: str, most: int) -> np.ndarray:
    """The text's most frequent n-grams, ties by code."""
    codes = grams(text)
    if not len(codes):
        return codes
    codes, n = counted(codes)
    return codes[np.argsort(-n, kind="stable")[:most]]


def learn(df: DataFrame, lang: str = "lang", text: str = "text", most: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of all languages: their n-grams by rank. Counts are summed in each task, then by n-gram."""

    def work(langs: pa.Array, texts: pa.Array):
        own: dict[str, list[np.ndarray]] = {}
        for k, t in zip(langs.to_pylist(), texts.to_pylist(), strict=True):
            own.setdefault(k, []).append(grams(t))
        for k, codes in own.items():
            codes, n = counted(np.concatenate(codes)) if any(map(len, codes)) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

    counts = map_texts(df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), lang, text, work, "lang string, code bigint, n bigint")
    sums = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    first = sums.withColumn("rank", rank).where(F.col("rank") <= most)
    profiles = first.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "code"))).alias("p"))  # `most` n-grams a language
    rows = profiles.select("lang", F.col("p.code").alias("codes")).limit(MOST_LANGUAGES + 1).toArrow().to_pylist()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"column {lang} has over {MOST_LANGUAGES} different values")
    return {r["lang"]: r["codes"] for r in sorted(rows, key=lambda r: r["lang"])}


class Profiles:
    """Profiles by n-gram: for each, the languages that have it and its rank there, one after the other. Linear in the profiles."""

    def __init__(self, profiles: dict[str, list[int]], most: int):
        self.langs, self.most = sorted(profiles), most
        sizes = [len(profiles[k]) for k in self.langs]
        codes = np.concatenate([np.array(profiles[k], np.int64) for k in self.langs] or [np.zeros(0, np.int64)])
        order = np.argsort(codes, kind="stable")
        self.of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.rank = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes] or [np.zeros(0, np.int32)])[order]
        self.codes, first = np.unique(codes[order], return_index=True)
        self.first = np.append(first, len(codes))

    def distances(self, codes: np.ndarray) -> np.ndarray:
        """The out-of-place distance of each language from a text's n-grams, given by rank."""
        at = np.searchsorted(self.codes, codes)
        known = np.flatnonzero(np.append(self.codes, -1)[at] == codes)
        start, n = self.first[at[known]], self.first[at[known] + 1] - self.first[at[known]]
        # The places in `of` and `rank` of all known n-grams, and the text's rank at each.
        places = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        nearer = self.most - np.abs(self.rank[places] - np.repeat(known, n))
        return self.most * len(codes) - np.bincount(self.of[places], nearer, len(self.langs)).astype(np.int64)

    def nearest(self, text: str | None, most: int) -> tuple[str, float]:
        """The language, and by how much of the next one's distance it is nearer."""
        codes = ranking(text or "", most)
        if not len(codes) or not len(self.langs):
            return "und", 0.0
        apart = self.distances(codes)
        order = np.argsort(apart, kind="stable")
        if len(order) == 1:
            return self.langs[0], 1.0 - float(apart[0]) / (self.most * len(codes))
        best, next_ = apart[order[0]], apart[order[1]]
        return self.langs[order[0]], float(1 - best / next_) if next_ else 0.0


def predict(df: DataFrame, profiles: dict[str, list[int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score)."""
    kind = df.schema[key].dataType.simpleString()
    model = df.sparkSession.sparkContext.broadcast(Profiles(profiles, PROFILE))  # PROFILE n-grams a language, MOST_LANGUAGES at most

    def work(keys: pa.Array, texts: pa.Array):
        found = [model.value.nearest(t, OF_TEXT) for t in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([keys, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[key, "lang_pred", "score"])

    return map_texts(df, key, text, work, f"`{key}` {kind}, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = learn(docs.where(remainder("doc_id", 4) != 2))
    return predict(docs, profiles).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language": op6_language}
ORACLE_SQL: dict[str, str] = {}
