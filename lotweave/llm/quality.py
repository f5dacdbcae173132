"""Quality by pairwise ranking (operator 5).

A text's features are shares and rates of its characters, words and lines. Each is cut into steps at the training texts'
quantiles, so that the score is a sum of step functions. Weights are learned by Bradley-Terry: the logistic loss of the difference
of features, over all pairs of a preferred and another text. The threshold is the quantile of training scores that leaves as many
below as there are rejected texts; a logistic curve, moved so that the threshold lies at 0.3, maps scores to 0..1.

All labelled rows are used, for edges, weights, threshold and curve. They stay on the executors, which return sums of a fixed size:
quantiles are exact order statistics, found digit by digit from counts; the loss and its gradient over all pairs follow from
the moments of scores in narrow cells, by a Taylor series of ORDER terms (about 1e-8 off); Newton's curvature is summed over all
rows too, by cells. Sums are of whole numbers, so results don't depend on how rows are dealt to tasks.

Defined cases: null and empty texts have the features of a text without words and get a score like others; with labels of one
kind only, or none, all scores are 0.5; equal rows get equal results; texts of any length are handled whole. Other columns are
not read.
"""

from __future__ import annotations

import zlib
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.llm.codes import span_codes, word_spans
from lotweave.llm.common import documents, durable, importable, map_texts, text_bytes
from lotweave.llm.labels import fit_line, remainder, sigmoid

#: Steps of a feature, rounds at most, and the gradient's norm at which they end.
STEPS, ROUNDS, FLAT = 16, 25, 1e-4
RIDGE = 1e-4
ACCEPT = 0.3

#: Where edges lie; the tails are where bad texts are: more steps there.
QUANTILES = [*np.linspace(0, 1, STEPS + 1)[1:-1], 0.002, 0.005, 0.01, 0.02, 0.04, 0.96, 0.98, 0.99, 0.995, 0.998]

#: Width of a cell of scores and terms of the series in it; cells for the curve; what sums of fractions are multiplied by.
CELL, ORDER, FINE, WHOLE = 0.25, 8, 1 / 256, float(1 << 32)

#: Bits of a number that a pass of the search for quantiles settles.
DIGITS = (12, 9, 9, 9, 9, 8, 8)

#: Rows that a worker handles at once, rows of a task, and tasks' sums that are added at once.
ROWS, TASK_ROWS, FAN_IN = 1 << 12, 1 << 18, 8

#: Added to denominators, so that shares of very short texts are not extreme.
FEW_CHARS, FEW_WORDS = 60, 10

FEATURES = ["log_words", "upper", "digits", "non_ascii", "stops", "bars", "marks", "signs", "brackets", "lines", "word_length", "long_words", "no_letters", "sign_ends", "same_next", "distinct", "most_common", "repeated_pairs"]


def _classes() -> np.ndarray:
    """By byte: upper case, digit, non-ASCII, stop or comma, bar, ! or ?, other sign, bracket or quote, line feed, letter."""
    out = np.zeros((256, 10), np.float32)
    for c in range(256):
        ch = chr(c)
        k = (
            0 if "A" <= ch <= "Z" else 1 if ch.isascii() and ch.isdigit() else 2 if c > 127 else 3 if ch in ".,;:" else 4 if ch == "|"
            else 5 if ch in "!?" else 7 if ch in "()[]{}<>\"'" else 8 if ch == "\n" else 9 if ch.isalpha() else None if ch.isspace() or c < 32 else 6
        )
        if k is not None:
            out[c, k] = 1
    return out


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    starts, ends, first = word_spans(data, offsets)
    codes = span_codes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    kinds = _classes()
    letters = kinds[:, [0, 2, 9]].any(1)
    sign = kinds[:, [4, 5, 6]].any(1)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        counts = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
        by = counts @ kinds
        size, words = max(1, counts.sum() - counts[32] - counts[9:14].sum()), b - a
        length = ends[a:b] - starts[a:b]
        own = codes[a:b]
        at = starts[a:b]
        _, times = np.unique(own, return_counts=True)
        pairs = own[1:] * np.uint64(3) + own[:-1]
        size, some = size + FEW_CHARS, words + FEW_WORDS
        out[i] = [
            np.log1p(words), by[0] / (by[0] + by[9] + FEW_CHARS), by[1] / size, by[2] / size, by[3] / some, by[4] / some, by[5] / some, by[6] / some, by[7] / some, by[8] / some,
            length.mean(), (length > 20).sum() / some, (~(letters[data[at]] | letters[data[ends[a:b] - 1]])).sum() / some, sign[data[ends[a:b] - 1]].sum() / some,
            (own[1:] == own[:-1]).sum() / some, len(times) / words**0.8, times.max() / some, (len(pairs) - len(np.unique(pairs))) / some,
        ]
    return out


class Ranker:
    """Step edges by feature, a weight by step, the threshold, and the slope of the curve."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, threshold: float = 0.0, slope: float = 0.0):
        self.edges, self.weights, self.threshold, self.slope = edges, weights, threshold, slope

    @staticmethod
    def steps(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Column numbers, one a feature, of the steps that rows of features lie in."""
        own = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1)
        return own + np.arange(len(edges)) * (edges.shape[1] + 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.steps(x, self.edges)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(x), 0.5)
        return sigmoid(self.slope * (self.raw(x) - self.threshold) + np.log(ACCEPT / (1 - ACCEPT)))


def pairwise(good: np.ndarray, bad: np.ndarray, block: int = 1 << 20) -> tuple[float, np.ndarray, np.ndarray]:
    """Of all pairs of a good and a bad score: the mean logistic loss of their difference, and its slopes by each score."""
    by_good, by_bad, loss = np.zeros(len(good)), np.zeros(len(bad)), 0.0
    step = max(1, block // len(bad))
    low = bad.astype(np.float32)
    for k in range(0, len(good), step):
        e = np.exp(np.clip(low - good[k : k + step, None].astype(np.float32), -60, 60))
        loss += np.log1p(e).sum(dtype=np.float64)
        e /= 1 + e
        by_good[k : k + step] = -e.sum(1, dtype=np.float64)
        by_bad += e.sum(0, dtype=np.float64)
    n = len(good) * len(bad)
    return loss / n, by_good / n, by_bad / n


class Here:
    """Rows of numbers and labels in memory."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y

    def sums(self, work) -> np.ndarray:
        """The sum of work(x, y), an array of whole numbers, over all rows."""
        return sum(work(self.x[k : k + ROWS], self.y[k : k + ROWS]) for k in range(0, max(1, len(self.y)), ROWS))

    def steps(self, edges: np.ndarray):
        return Here(Ranker.steps(self.x, edges), self.y)


class There:
    """Rows (label int, x binary) on the executors."""

    def __init__(self, df: DataFrame, kind: str, width: int):
        self.df, self.kind, self.width = durable(df), kind, width
        self.tasks = -(-self.df.count() // TASK_ROWS)
        # Six tasks and more if there are as many files, fewer than files if these are small.
        self.tasks = min(max(6, self.tasks), max(1, self.df.rdd.getNumPartitions()))

    def mapped(self, work, schema: str) -> DataFrame:
        kind, width = self.kind, self.width

        def run(batches):
            def parts():
                for b in batches:
                    for k in range(0, len(b), ROWS):
                        part = b.slice(k, ROWS)
                        x = np.frombuffer(b"".join(part.column(1).to_pylist()), kind).reshape(-1, width)
                        yield x, np.asarray(part.column(0)).astype(np.int64)

            yield from work(parts())

        importable(self.df.sparkSession)
        return self.df.coalesce(self.tasks).mapInArrow(run, schema)

    def sums(self, work) -> np.ndarray:
        empty = np.zeros((0, self.width), self.kind), np.zeros(0, np.int64)

        def own(parts):
            from pyspark import TaskContext

            total = sum((work(x, y) for x, y in parts), work(*empty))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([packed(total)], pa.binary())], names=["task", "sums"])

        def add(table: pa.Table) -> pa.Table:
            return pa.table({"task": table.column("task")[:1], "sums": pa.array([packed(sum(map(unpacked, table.column("sums").to_pylist())))], pa.binary())})

        df, tasks = self.mapped(own, "task int, sums binary"), self.tasks
        while tasks > FAN_IN:
            df = df.withColumn("task", F.expr(f"task div {FAN_IN}").cast("int")).groupBy("task").applyInArrow(add, "task int, sums binary")
            tasks = -(-tasks // FAN_IN)
        return sum(unpacked(r.sums) for r in df.collect())  # FAN_IN rows at most

    def steps(self, edges: np.ndarray):
        def work(parts):
            for x, y in parts:
                own = Ranker.steps(x, edges).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array([r.tobytes() for r in own], pa.binary())], names=["label", "x"])

        return There(self.mapped(work, "label int, x binary"), "u2", self.width)


def packed(sums: np.ndarray) -> bytes:
    return zlib.compress(sums.astype(np.int64).tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), np.int64)


def ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of x."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def at_ranks(rows, ranks: np.ndarray, columns: int, values=lambda x: x) -> np.ndarray:
    """The numbers at these ranks (from 0) of each column of values(x), over all rows: exact, from counts of digits."""
    found, left, done = np.zeros((columns, len(ranks)), np.uint64), np.tile(np.asarray(ranks, np.int64), (columns, 1)), 0
    for bits in DIGITS:
        heads = [np.unique(f) for f in found]
        first = np.cumsum([0, *map(len, heads)])

        def work(x, y, heads=heads, first=first, bits=bits, done=done):
            keys, out = ordered(np.ascontiguousarray(values(x))), np.zeros((first[-1], 1 << bits), np.int64)
            digit = (keys >> np.uint64(64 - done - bits)).astype(np.uint64) & np.uint64((1 << bits) - 1)
            head = keys >> np.uint64(64 - done) if done else np.zeros_like(keys)
            for j, h in enumerate(heads):
                at = np.minimum(np.searchsorted(h, head[:, j]), len(h) - 1)
                some = h[at] == head[:, j]
                out[first[j] : first[j + 1]] += np.bincount((at[some] << bits) + digit[some, j].astype(np.int64), minlength=len(h) << bits).reshape(len(h), -1)
            return out.ravel()

        counts = rows.sums(work).reshape(first[-1], 1 << bits)
        below = np.cumsum(counts, 1)
        for j, h in enumerate(heads):
            at = first[j] + np.searchsorted(h, found[j])
            for k, row in enumerate(at):
                d = int(np.searchsorted(below[row], left[j, k], side="right"))
                left[j, k] -= below[row, d - 1] if d else 0
                found[j, k] = found[j, k] << np.uint64(bits) | np.uint64(d)
        done += bits
    high = found >> np.uint64(63) == 1
    return np.where(high, found & np.uint64((1 << 63) - 1), ~found).view(np.float64)


def quantiles(rows, n: int, q, columns: int) -> np.ndarray:
    """numpy's quantiles (columns, len(q)) of all n rows."""
    at = np.asarray(q) * (n - 1)
    low = np.floor(at).astype(np.int64)
    ranks = np.unique(np.append(low, np.minimum(low + 1, n - 1)))
    x = at_ranks(rows, ranks, columns)
    a, b, t = x[:, np.searchsorted(ranks, low)], x[:, np.searchsorted(ranks, np.minimum(low + 1, n - 1))], at - low
    return np.where(t < 0.5, a + (b - a) * t, b - (b - a) * (1 - t))


def slopes(d: np.ndarray, most: int) -> list[np.ndarray]:
    """log(1 + exp(-d)) and its derivatives up to the order `most`."""
    s, p = sigmoid(d), np.polynomial.Polynomial([0, 1])
    out = [np.logaddexp(0, -d), -sigmoid(-d)]
    for _ in range(2, most + 1):
        p = p.deriv() * np.polynomial.Polynomial([0, 1, -1])
        out.append(p(s))
    return out


def cells_of(w: np.ndarray, own: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    """By row: the cell of its score, and how far from the cell's middle it lies."""
    raw = w[own].sum(1)
    cell = np.floor((raw - low) / CELL).astype(np.int64)
    return cell, raw - low - (cell + 0.5) * CELL


class Pairwise:
    """The mean loss of all pairs of a good and a bad row, its slope, and its curvature, at weights w."""

    def __init__(self, rows, w: np.ndarray, features: int):
        self.rows, self.w, self.columns = rows, w, len(w)
        self.low = low = float(features * w.min()) - CELL / 2
        k = int((features * w.max() - low) / CELL) + 2
        columns = self.columns

        def work(own, y):
            own = own.astype(np.int64)
            cell, off = cells_of(w, own, low)
            at = y * k + cell
            moments = [np.bincount(at, np.rint(off**m * WHOLE), 2 * k) for m in range(ORDER)]
            members = np.bincount((at[:, None] * columns + own).ravel(), minlength=2 * k * columns)
            return np.concatenate([np.stack(moments, 1).ravel().astype(np.int64), members])

        got = rows.sums(work)
        moments = got[: 2 * k * ORDER].reshape(2, k, ORDER) / WHOLE
        self.members = got[2 * k * ORDER :].reshape(2, k, columns).astype(np.float64)
        self.n = moments[:, :, 0].sum(1)
        # Cells without rows are left out.
        self.some = [np.flatnonzero(m[:, 0]) for m in moments]
        self.bad, self.good = [m[c] / n for m, c, n in zip(moments, self.some, self.n, strict=True)]
        middle = np.arange(k) * CELL
        self.by = slopes(middle[self.some[1]][:, None] - middle[self.some[0]], ORDER + 1)
        self.k = k
        self.loss = sum(self.good[:, i] @ self.by[m] @ self.bad[:, m - i] * comb(m, i) * (-1) ** (m - i) / factorial(m) for m in range(ORDER) for i in range(m + 1)) + RIDGE / 2 * (w @ w)

    def turned(self) -> tuple[np.ndarray, np.ndarray]:
        """The slope and the curvature by weights."""
        k, w, low, columns = self.k, self.w, self.low, self.columns
        series, bend = np.zeros((2, k, ORDER)), np.zeros((2, k))
        for m in range(ORDER):
            for j in range(ORDER - m):
                by = self.by[1 + m + j] / (factorial(m) * factorial(j))
                series[1, self.some[1], m] += (-1) ** j * (by @ self.bad[:, j])
                series[0, self.some[0], m] -= (-1) ** m * (self.good[:, j] @ by)
        bend[1, self.some[1]], bend[0, self.some[0]] = self.by[2] @ self.bad[:, 0], self.good[:, 0] @ self.by[2]

        def work(own, y):
            own = own.astype(np.int64)
            cell, off = cells_of(w, own, low)
            slope, curve = np.zeros((2, columns)), np.zeros((2, columns * columns))
            for c in (0, 1):
                mine, at, d = own[y == c], cell[y == c], off[y == c]
                each = sum(series[c, at, m] * d**m for m in range(ORDER))
                slope[c] = np.bincount(mine.ravel(), np.repeat(np.rint(each * WHOLE), own.shape[1]), columns)
                both = (mine[:, :, None] * columns + mine[:, None, :]).reshape(len(mine), own.shape[1] ** 2)
                curve[c] = np.bincount(both.ravel(), np.repeat(np.rint(bend[c, at] * WHOLE), both.shape[1]), columns * columns)
            return np.concatenate([slope.ravel(), curve.ravel()]).astype(np.int64)

        got = self.rows.sums(work) / WHOLE
        slope = (got[: 2 * columns].reshape(2, columns) / self.n[:, None]).sum(0)
        own = (got[2 * columns :].reshape(2, columns, columns) / self.n[:, None, None]).sum(0)
        cross = (self.members[1, self.some[1]].T / self.n[1]) @ self.by[2] @ (self.members[0, self.some[0]] / self.n[0])
        return slope + RIDGE * w, own - cross - cross.T


def weights_of(rows, columns: int, features: int) -> np.ndarray:
    """The weights of `columns` steps that minimise the pairs' mean loss and RIDGE; rows: the columns that each lies in, and labels."""
    now = Pairwise(rows, np.zeros(columns), features)
    for _ in range(ROUNDS):
        slope, curve = now.turned()
        if np.linalg.norm(slope) < FLAT:
            break
        step = np.linalg.solve(curve + 2 * RIDGE * np.eye(columns), slope)
        size = 1.0
        while size > 1e-3:
            new = Pairwise(rows, now.w - size * step, features)
            if new.loss < now.loss:
                break
            size /= 4
        else:
            break
        now = new
    return now.w


def bradley_terry(own: np.ndarray, y: np.ndarray, columns: int) -> np.ndarray:
    """weights_of() rows in memory."""
    return weights_of(Here(own, y), columns, own.shape[1])


def fit(rows) -> Ranker:
    """A ranker from all rows of features and labels (1: preferred)."""
    bad, n = rows.sums(lambda x, y: np.array([(y == 0).sum(), len(y)])).tolist()
    width = len(FEATURES)
    edges = np.sort(quantiles(rows, n, QUANTILES, width), 1) if n else np.zeros((width, len(QUANTILES)))
    columns = width * (edges.shape[1] + 1)
    if not bad or bad == n:
        return Ranker(edges, np.zeros(columns))
    own = rows.steps(edges)
    w = weights_of(own, columns, width)
    ranker = Ranker(edges, w)
    ranker.threshold = float(at_ranks(own, np.array([bad - 1, bad]), 1, lambda x: w[x].sum(1)[:, None]).mean())
    # The curve: two points for each fine cell and label, which have its rows' number, mean and variance.
    low = float(width * w.min())
    k = int((width * w.max() - low) / FINE) + 2

    def work(x, y):
        at = (w[x].sum(1) - low) / FINE
        cell = np.floor(at).astype(np.int64)
        return np.concatenate([np.bincount(y * k + cell, np.rint((at - cell) ** m * WHOLE), 2 * k) for m in range(3)]).astype(np.int64)

    count, one, two = own.sums(work).reshape(3, 2 * k) / WHOLE
    some = np.flatnonzero(count)
    count, one, two = count[some], one[some] / count[some], two[some] / count[some]
    spread = np.sqrt(np.maximum(two - one**2, 0))
    middle = low + FINE * (some % k + one)
    raw, label, times = np.append(middle - FINE * spread, middle + FINE * spread), np.tile(some // k, 2), np.tile(count / 2, 2)
    mean = np.average(raw, weights=times)
    scale = np.sqrt(np.average((raw - mean) ** 2, weights=times)) + 1e-9
    ranker.slope = max(fit_line((raw - mean) / scale, label, times=times)[0] / scale, 1e-3)
    return ranker


def learn(rows: DataFrame) -> Ranker:
    """A ranker from (label, x) rows, x being a text's features as bytes."""
    return fit(There(rows, "f8", len(FEATURES)))


def featured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x)."""
    kind = docs.schema[key].dataType.simpleString()

    def work(keys: pa.Array, texts: pa.Array):
        yield pa.RecordBatch.from_arrays([keys, pa.array([r.tobytes() for r in features(texts)], pa.binary())], names=[key, "x"])

    return map_texts(docs, key, text, work, f"`{key}` {kind}, x binary")


def score(df: DataFrame, ranker: Ranker, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score)."""
    kind = df.schema[key].dataType.simpleString()

    def work(keys: pa.Array, texts: pa.Array):
        yield pa.RecordBatch.from_arrays([keys, pa.array(ranker.score(features(texts)))], names=[key, "score"])

    return map_texts(df, key, text, work, f"`{key}` {kind}, score double")


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """From all documents that have a label of 0 or 1 and aren't held out; what travels to their labels is numbers, not texts."""
    chosen = remainder("doc_id", 5) != 0
    known = labels.where(chosen & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    return learn(featured(docs.where(chosen)).join(known, "doc_id").select(F.col("label").cast("int"), "x"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score(docs, train(docs, documents(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
ORACLE_SQL: dict[str, str] = {}
