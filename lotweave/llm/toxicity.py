"""Toxicity by a weighted lexicon (operator 10).

Texts are folded first: letters are lowered, look-alike letters of other scripts, full-width forms and digits or signs that
stand for letters become the plain letter (l and i, which look alike, become one), invisible characters go, and all else becomes a blank. The lexicon has whole words
and beginnings of words, each with the log odds of its texts' labels as its weight; it is learned from labelled training texts.
An Aho-Corasick automaton finds its entries. Matches inside an exception phrase don't count; exception phrases are two words
around a match that training shows mostly in clean texts. The weights' sum over the number of words is the text's density, and
a logistic curve turns that into the score.

Defined cases: null and empty texts have density 0 (and so the least score); without training rows of both labels the lexicon
is empty and all scores are 0; equal rows get equal results; texts of any length are handled whole. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.llm.common import documents, durable, map_texts
from lotweave.llm.labels import fit_line, labelled, remainder, sigmoid, spread_out

# Look-alike letters (Cyrillic, Greek, others) and the signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "i", "ø": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i",
}
INVISIBLE = "­​‌‍⁠﻿"

#: Lengths of the beginnings of words that can be entries; an entry's least weight (log odds), and how much its
#: log-likelihood ratio against being spread over the labels at random must exceed what the best of so many terms has by chance.
STEMS = (4, 5, 6, 7)
LEAST_WEIGHT, BEYOND_CHANCE = 3.0, 4.0

#: Texts whose terms a worker counts at once: each has many more terms than words.
TERM_BYTES = 1 << 19


class Folding(dict):
    """A translation table that fills itself: letters stay, all else becomes a blank."""

    def __missing__(self, c: int):
        ch = chr(c)
        if ch in INVISIBLE:
            out = None
        elif ch in LOOKALIKES:
            out = LOOKALIKES[ch]
        elif 0xFF01 <= c <= 0xFF5E:
            out = self[ord(chr(c - 0xFEE0).lower())]
        else:
            out = ch if ch.isalpha() else " "
        self[c] = out
        return out


def fold(text: str, table: Folding) -> list[str]:
    """The words of a folded text. Signs count as letters only inside words: a run of signs and digits alone is no word."""
    words = []
    for w in text.lower().split():
        if w.isalpha() and w.isascii():
            words.append(w.replace("l", "i"))
            continue
        # Signs at the end of a word are punctuation, not letters; those before it may be either, so it is read both ways.
        w = w.rstrip("!|,.;:?")
        bare = w.lstrip("!|")
        if any(c.isalpha() for c in bare):
            words += bare.translate(table).split()
            if len(bare) == len(w) - 1:
                words += w.translate(table).split()
        else:
            words.append("0")
    return words


class Lexicon:
    """entries: {word or stem*: weight}; exceptions: phrases of two words; slope and intercept of the curve over density."""

    def __init__(self, entries: dict[str, float], exceptions: list[str] = (), slope: float = 1.0, intercept: float = -40.0):
        # As texts are folded: l, i, 1, | and ! are one letter.
        self.entries, self.exceptions = {e.replace("l", "i"): w for e, w in entries.items()}, [e.replace("l", "i") for e in exceptions]
        self.slope, self.intercept = slope, intercept

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "table")}

    @cached_property
    def table(self) -> Folding:
        return Folding()

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for e, w in self.entries.items():
            p = f" {e[:-1]}" if e.endswith("*") else f" {e} "
            found.add_word(p, (len(p), w))
        for e in self.exceptions:
            found.add_word(f" {e} ", (len(e) + 2, None))
        found.make_automaton()
        return found

    def matches(self, words: list[str]) -> dict[int, float]:
        """By where a word begins in the joined words: the greatest weight that matches there, outside exceptions."""
        if not self.entries:
            return {}
        got: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > got.get(start, 0.0):
                got[start] = weight
        for a, b in spared:
            for start in [s for s in got if a <= s < b]:
                del got[start]
        return got

    def density(self, text: str | None) -> tuple[float, int]:
        """Weight in a thousand words (of 20 words at least), and how many words match."""
        words = fold(text or "", self.table)
        got = self.matches(words)
        return 1000.0 * sum(got.values()) / max(len(words), 20), len(got)

    def score(self, density: float) -> float:
        return float(sigmoid(self.slope * np.log1p(density) + self.intercept)) if self.entries else 0.0


def distinct_entries(weights: dict[str, float]) -> dict[str, float]:
    """Entries without longer ones that add nothing to their beginning, and without beginnings that owe their weight to longer ones."""
    kept: dict[str, float] = {}
    for e in sorted(weights, key=lambda e: (len(e.rstrip("*")), not e.endswith("*"), e)):
        body = e.rstrip("*")
        shorter = [x for k in STEMS if (k < len(body) or (k == len(body) and e != f"{body}*")) and (x := f"{body[:k]}*") in kept]
        if all(weights[x] < weights[e] - 0.7 for x in shorter):
            for x in shorter:
                del kept[x]
            kept[e] = weights[e]
    return kept


def term_counts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, a, b): in how many texts with label 1 and 0 each word and stem occurs."""
    table = Folding()

    def terms(keys: pa.Array, texts: pa.Array, labels: pa.Array):
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for t, y in zip(texts.to_pylist(), labels.to_pylist(), strict=True):
            words = set(fold(t, table))
            counts[y].update(words)
            counts[y].update({f"{w[:k]}*" for w in words for k in STEMS if len(w) >= k})
        for y, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["term", "label", "n"])

    found = map_texts(rows, key, "text", terms, "term string, label int, n bigint", ("label",), TERM_BYTES)
    return found.groupBy("term").agg(F.sum(F.col("n") * F.col("label")).alias("a"), F.sum(F.col("n") * (1 - F.col("label"))).alias("b"))


def learn(rows: DataFrame, key: str = "doc_id") -> Lexicon:
    """A lexicon from (key, text, label) rows; see labels.labelled for the bound on their number, which bounds its entries."""
    rows = durable(spread_out(rows, key))
    totals = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Lexicon({})
    found = term_counts(rows, key)
    weight = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    share = n1 / (n1 + n0)
    part = lambda x, p: F.when(x > 0, x * F.log(x / ((F.col("a") + F.col("b")) * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("a"), share) + part(F.col("b"), 1 - share))
    tested = durable(found.where("a > 1").select("term", weight.alias("w"), ratio.alias("ratio")))
    least = 2 * np.log(max(tested.count(), 1)) + BEYOND_CHANCE
    best = tested.where((F.col("w") >= LEAST_WEIGHT) & (F.col("ratio") >= float(least))).collect()
    entries = distinct_entries({r.term: r.w for r in best})
    plain = Lexicon(entries)

    def phrases(keys: pa.Array, texts: pa.Array, labels: pa.Array):
        counts: Counter = Counter()
        for t, y in zip(texts.to_pylist(), labels.to_pylist(), strict=True):
            words = fold(t, plain.table)
            got = plain.matches(words)
            if got:
                starts = np.cumsum([0, *[len(w) + 1 for w in words]])
                at = {int(s): i for i, s in enumerate(starts)}
                here = set()
                for s in got:
                    i = at[s]
                    here.update(" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j < len(words) - 1)
                counts.update((p, y) for p in here)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["term", "label", "n"])

    met = map_texts(rows, key, "text", phrases, "term string, label int, n bigint", ("label",)).groupBy("term").agg(F.sum(F.col("n") * F.col("label")).alias("a"), F.sum(F.col("n") * (1 - F.col("label"))).alias("b"))
    spared = met.where((F.col("b") >= 3) & (F.col("b") / n0 >= 3 * (F.col("a") + 0.5) / n1)).collect()
    lexicon = Lexicon(entries, sorted(r.term for r in spared))

    def densities(keys: pa.Array, texts: pa.Array, labels: pa.Array):
        yield pa.RecordBatch.from_arrays([labels, pa.array([lexicon.density(t)[0] for t in texts.to_pylist()], pa.float64())], names=["label", "density"])

    # As many numbers as there are labelled rows, which are bounded.
    points = map_texts(rows, key, "text", densities, "label int, density double", ("label",)).collect()
    density, label = np.array(sorted((r.density, r.label) for r in points)).T  # in an order that doesn't depend on the tasks
    lexicon.slope, lexicon.intercept = fit_line(np.log1p(density), label)
    return lexicon


def score(df: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, density, n_matches)."""
    kind = df.schema[key].dataType.simpleString()

    def work(keys: pa.Array, texts: pa.Array):
        got = [lexicon.density(t) for t in texts.to_pylist()]
        columns = [pa.array([lexicon.score(d) for d, _ in got], pa.float64()), pa.array([d for d, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64())]
        yield pa.RecordBatch.from_arrays([keys, *columns], names=[key, "score", "density", "n_matches"])

    return map_texts(df, key, text, work, f"`{key}` {kind}, score double, density double, n_matches bigint")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon = learn(labelled(docs, documents(spark, sf_dir, "labels"), "toxic", remainder("doc_id", 4) != 2))
    out = score(docs, lexicon)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_matches")


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE_SQL: dict[str, str] = {}
