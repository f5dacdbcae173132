"""Benchmark decontamination by exact pieces, a tree of checks and edit distances (operator 4).

Texts and items are lowered (A-Z) and their white space becomes single blanks. An item that may have k edits (`percent` of its
length) is cut into k + 1 pieces of nearly equal length, so that at least one of them stands unchanged in any stretch of text
that matches. Every byte of a text is a possible start of a piece, whatever its words, script or length; no match is missed.

Pieces are short (6 bytes at 15 percent), so most places where one is found are chance. They are the leaves of a binary tree in
which a node of g pieces may have g - 1 edits: if all nodes above all unchanged pieces had more, so had the item. A piece's
place must pass the nodes of two, four and eight pieces above it, which are checked for many places at once. For each candidate
left the item's exact edit distance to the best fitting stretch around its place is found; a text is contaminated by an item
within `percent` of the item's length.

Items are handled in blocks of a bounded size, which is what is broadcast; the work grows with the places where pieces are
found, so with the items. Defined cases: null and empty texts hold nothing; very short items (under 16 bytes) are compared by
containment of whole words (in scripts without blanks, of characters), null and empty items are in no text; repeated rows each get
their matches, a repeated item is reported under each of its ids; texts of any length are handled whole. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.llm.codes import scatter, separators
from lotweave.llm.common import documents, map_texts, text_bytes

PERCENT = 15
#: Codes of a walk, and sampled steps in a code.
CODES, SAMPLED = 8, 8
#: Bytes of items that are searched for at once.
BLOCK_BYTES = 8 << 20
SHORTEST = 16
#: Length of the byte runs that are counted before an edit distance is found.
Q, RUN_BITS = 5, 14
RUN = 1 << 13  # windows that walk, and places that are checked, side by side
#: Places of a text that are looked up at once, and finds of pieces that are followed at once.
PLACES, FINDS = 1 << 17, 1 << 19
#: Zero bytes before and behind each text.
GAP = 16
#: First characters of scripts written without blanks, and their ends: Thai and Lao, Tibetan, Burmese, Khmer, kana and Han.
UNSPACED = ((0x0E00, 0x1100), (0x1780, 0x1800), (0x2E80, 0xA4D0), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x32000))
LOW = np.uint64(0x0101010101010101)


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowered bytes with single blanks, no blanks at the ends of a text, and the new offsets."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    sep = separators()[data]
    out = np.where(sep, np.uint8(32), lower[data])
    before = np.append(True, sep[:-1])
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    keep = ~(sep & before)
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    cut = ends[sep[ends]]  # a run's first blank may stand before it
    total = np.append(0, np.cumsum(keep))
    where = np.flatnonzero(keep)
    for e in cut:
        k = total[e + 1] - 1
        if k >= 0 and where[k] >= offsets[np.searchsorted(offsets, e, side="right") - 1]:
            keep[where[k]] = False
    total = np.append(0, np.cumsum(keep))
    return out[keep], total[offsets]


def padded(data: np.ndarray, offsets: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with `gap` zero bytes behind each, and where each starts."""
    sizes = np.diff(offsets)
    starts = offsets[:-1] + gap * np.arange(len(sizes))
    out = np.zeros(len(data) + gap * (len(sizes) + 1), np.uint8)
    out[np.arange(len(data)) + np.repeat(gap * np.arange(len(sizes)), sizes)] = data
    return out, starts


@dataclass
class Walk:
    """The random choices of a CGK walk for windows of `size` bytes: 2 * size steps. The search for items doesn't use it."""

    size: int
    seed: int

    def __post_init__(self):
        rng = np.random.default_rng([self.seed, self.size])
        self.moves = rng.integers(0, 2, (2 * self.size, 256)).astype(np.int64)
        self.moves[:, 0] = 0  # behind the end it stays
        self.sampled = [np.sort(rng.choice(2 * self.size, SAMPLED, replace=False)) for _ in range(CODES)]

    def codes(self, buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
        """CODES codes for each window that starts at `at`."""
        out = np.zeros((CODES, len(at)), np.uint64)
        takes = [[t for t in range(CODES) if j in self.sampled[t]] for j in range(2 * self.size)]
        last = max(x[-1] for x in self.sampled)
        for k in range(0, len(at), RUN):
            p = at[k : k + RUN].astype(np.int64)
            part = out[:, k : k + RUN]
            c, move = np.empty(len(p), np.uint8), np.empty(len(p), np.int64)
            for j in range(last + 1):
                buffer.take(p, out=c, mode="clip")
                for t in takes[j]:
                    part[t] *= np.uint64(0x100000001B3)
                    part[t] += c
                self.moves[j].take(c, out=move, mode="clip")
                p += move
        for t in range(CODES):
            out[t] = scatter(out[t] + np.uint64((self.seed * CODES + t) << 1))
        return out


def run_codes(data: np.ndarray) -> np.ndarray:
    """Codes of RUN_BITS bits of all runs of Q bytes."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint16)
    out = np.zeros(n, np.uint32)
    for k in range(Q):
        out *= np.uint32(0x01000193)
        out += data[k : k + n]
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(32 - RUN_BITS)).astype(np.uint16)


def edit_distance(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edits between item and any stretch of text, and where that stretch ends (bit-parallel, one step a byte of text)."""
    m = len(item)
    at: dict[int, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << m - 1
    up, down, d = ones, 0, m
    best, end = m, 0
    for k, c in enumerate(text):
        eq = at.get(c, 0)
        x = eq | down
        diag = (((eq & up) + up) ^ up) | x
        gain = down | ~(diag | up) & ones
        lose = up & diag
        if gain & top:
            d += 1
        elif lose & top:
            d -= 1
        gain = gain << 1 & ones
        lose = lose << 1 & ones
        up = lose | ~(diag | gain) & ones
        down = gain & diag
        if d < best:
            best, end = d, k + 1
    return best, end


def eight(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, the first one lowest."""
    return np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,)).astype(np.uint64)


def differing(x: np.ndarray) -> np.ndarray:
    """The lowest bit of each byte that isn't zero."""
    x = x | x >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return x & LOW


def within_one(rest: np.ndarray, mask: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether `rest`, whose bytes are those of mask, begins `text` with one edit at most."""
    same = differing((rest ^ text) & mask)
    least = same & (~same + np.uint64(1))
    left_out = differing((rest ^ text << np.uint64(8)) & mask)
    put_in = differing((rest ^ text >> np.uint64(8)) & mask)
    return (same == least) | (left_out < least << np.uint64(1)) | (put_in < least)


def unspaced(char: str) -> bool:
    return any(a <= ord(char) < b for a, b in UNSPACED)


class Items:
    """A block of items with their pieces."""

    def __init__(self, ids: list, texts: list[str | None], percent: int):
        self.ids, self.percent = ids, percent
        data, offsets = normal(*text_bytes(pa.array(texts, pa.string())))
        self.texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.short = []
        for k, t in enumerate(self.texts):
            if 0 < len(t) < SHORTEST:
                chars = t.decode()
                self.short.append((k, b"" if unspaced(chars[0]) else b" ", b"" if unspaced(chars[-1]) else b" "))
        sizes = np.diff(offsets)
        most = sizes * percent // 100
        self.slack = np.maximum(1, most)
        self.data = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(16, np.uint8)])
        mine = np.flatnonzero(sizes >= SHORTEST)
        self.pieces = np.where(sizes >= SHORTEST, most + 1, 0)
        self.first = np.cumsum(self.pieces + 1) - self.pieces - 1
        # Where the pieces of item i begin in data: edges[first[i] :][: pieces[i] + 1], the last one is its end.
        of = np.repeat(np.arange(len(sizes)), self.pieces + 1)
        number = np.arange(len(of)) - self.first[of]
        self.edges = 8 + offsets[of] + sizes[of] * number // np.maximum(1, self.pieces[of])
        leaf = np.flatnonzero(number < self.pieces[of])
        self.item, self.number, self.at = of[leaf], number[leaf], self.edges[leaf]
        width = np.minimum(8, sizes // np.maximum(1, self.pieces))[self.item]
        words = eight(self.data)
        right = self.number % 2 == 0
        last = np.minimum(self.number | 1, self.pieces[self.item] - 1) + 1
        end = self.edges[self.first[self.item] + last]
        begin = self.edges[self.first[self.item] + (self.number & ~1)]
        n = np.where(right, end - self.at - width, self.at - begin)
        # The node of two pieces: what stands beside the piece, read away from it.
        rest = np.where(right, words[np.minimum(self.at + width, len(words) - 1)], words[self.at - 8].byteswap())
        mask = (np.uint64(1) << (np.uint64(8) * np.clip(n, 0, 7).astype(np.uint64))) - np.uint64(1)
        self.right, self.mask, self.rest = right, mask, rest & mask
        self.tables = []
        for q in np.unique(width[self.pieces[self.item] > 0]).tolist() if len(mine) else []:
            some = np.flatnonzero(width == q)
            bits = min(22, max(12, (16 * len(some)).bit_length()))
            key = words[self.at[some]] & np.uint64((1 << 8 * q) - 1)
            cell = self.cells(key, bits)
            order = np.argsort(cell, kind="stable")
            starts = np.append(0, np.cumsum(np.bincount(cell, minlength=1 << bits))).astype(np.int32)
            self.tables.append((q, bits, starts[1:] > starts[:-1], starts, key[order], some[order]))

    @staticmethod
    def cells(key: np.ndarray, bits: int) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def finds(self, buffer: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the buffer and pieces that begin there, as far as the nodes of two pieces allow."""
        for a in range(8, len(buffer) - GAP, PLACES):
            words = eight(buffer[a - 8 : min(len(buffer), a + PLACES + 16)])
            n = min(PLACES, len(words) - 17)
            for q, bits, some, starts, key, pieces in self.tables:
                here = words[8 : 8 + n] & np.uint64((1 << 8 * q) - 1)
                cell = self.cells(here, bits)
                at = np.flatnonzero(some[cell])
                cell = cell[at]
                times = (starts[cell + 1] - starts[cell]).astype(np.int64)
                total = np.append(0, np.cumsum(times))
                k = 0
                while k < len(at):
                    m = max(k + 1, int(np.searchsorted(total, total[k] + FINDS, side="right")) - 1)
                    place = np.repeat(at[k:m], times[k:m])
                    slot = np.arange(total[k], total[m]) - np.repeat(total[k:m] - starts[cell[k:m]], times[k:m])
                    good = here[place] == key[slot]
                    place, piece = place[good], pieces[slot[good]]
                    text = np.where(self.right[piece], words[place + 8 + q], words[place].byteswap())
                    good = within_one(self.rest[piece], self.mask[piece], text)
                    yield place[good] + a, piece[good]
                    k = m

    def passes(self, buffer: np.ndarray, place: np.ndarray, piece: np.ndarray, level: int) -> np.ndarray:
        """Whether the node of 2 ** level pieces above each piece has few enough edits around its place.

        The edit distance of edit_distance(), for many places at once; bytes count as equal if their five lowest bits are.
        """
        item, number = self.item[piece], self.number[piece]
        a = number >> level << level
        b = np.minimum(a + (1 << level), self.pieces[item])
        lo, hi = self.edges[self.first[item] + a], self.edges[self.first[item] + b]
        out = np.ones(len(place), bool)
        asked = np.flatnonzero((b - a > 1) & (hi - lo <= 64))
        one = np.uint64(1)
        for k in range(0, len(asked), RUN):
            x = asked[k : k + RUN]
            most, size = (b - a - 1)[x], (hi - lo)[x]
            node, which, of = np.unique(lo[x], return_index=True, return_inverse=True)
            of = of * 32
            length = size[which]
            equal = np.zeros((len(node), 32), np.uint64)
            for i in range(int(length.max())):
                j = np.flatnonzero(length > i)
                equal[j, self.data[node[j] + i] & 31] |= one << np.uint64(i)
            equal = equal.ravel()
            p = place[x] - (self.at[piece[x]] - lo[x]) - most
            top = (size - 1).astype(np.uint64)
            up, down = np.full(len(x), ~np.uint64(0)), np.zeros(len(x), np.uint64)
            d = size.copy()
            best = d.copy()
            for _ in range(int((size + 2 * most).max())):
                eq = equal.take(of + (buffer.take(p, mode="clip") & 31))
                v = eq | down
                diag = (((eq & up) + up) ^ up) | v
                gain = down | ~(diag | up)
                lose = up & diag
                d += (gain >> top & one).astype(np.int64)
                d -= (lose >> top & one).astype(np.int64)
                gain <<= one
                lose <<= one
                up = lose | ~(diag | gain)
                down = gain & diag
                np.minimum(best, d, out=best)
                p += 1
            out[x] = best <= most
        return out

    def found(self, buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Candidates as columns text, item, cell: the item would begin in that cell of the text, as wide as its slack."""
        out, place, piece, n = [np.zeros((3, 0), np.int64)], [], [], 0

        def checked():
            p, x = np.concatenate(place), np.concatenate(piece)
            for level in (2, 3):
                good = self.passes(buffer, p, x, level)
                p, x = p[good], x[good]
            doc = np.searchsorted(starts, p, side="right") - 1
            item = self.item[x]
            begin = self.edges[self.first[item]]
            out.append(np.unique(np.stack([doc, item, (p - (self.at[x] - begin) - starts[doc]) // self.slack[item]]), axis=1))

        for p, x in self.finds(buffer):
            place.append(p)
            piece.append(x)
            n += len(p)
            if n >= FINDS:
                checked()
                place, piece, n = [], [], 0
        if n:
            checked()
        return np.unique(np.concatenate(out, 1), axis=1).T

    def marked(self, i: int) -> np.ndarray:
        """By code: whether item i has a run with it."""
        known = self.__dict__.setdefault("_marked", {})
        if i not in known:
            if len(known) > 2048:
                known.clear()
            known[i] = np.zeros(1 << RUN_BITS, bool)
            known[i][run_codes(np.frombuffer(self.texts[i], np.uint8))] = True
        return known[i]

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, end) for each text and item within the distance, once, at its best place."""
        data, offsets = normal(*text_bytes(texts))
        buffer, starts = padded(data, offsets, GAP)
        buffer, starts = np.concatenate([np.zeros(GAP, np.uint8), buffer]), starts + GAP
        sizes = np.diff(offsets)
        runs = run_codes(buffer)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, i, cell in self.found(buffer, starts).tolist():
            if best.get((doc, i), (1, 0))[0] == 0:
                continue
            item, slack = self.texts[i], int(self.slack[i])
            lo, hi = max(0, (cell - 1) * slack), min(int(sizes[doc]), (cell + 2) * slack + len(item))
            # Each edit spoils Q runs of the item at most; the others are in the stretch.
            most = len(item) * self.percent // 100
            if np.count_nonzero(self.marked(i)[runs[starts[doc] + lo : starts[doc] + max(lo, hi - Q + 1)]]) < len(item) - Q + 1 - Q * most:
                continue
            region = buffer[starts[doc] + lo : starts[doc] + hi].tobytes()
            inside = region.find(item)
            d, end = (0, inside + len(item)) if inside >= 0 else edit_distance(item, region)
            if d * 100 <= self.percent * len(item) and d < best.get((doc, i), (len(item), 0))[0]:
                best[doc, i] = (d, lo + end)
        for i, before, behind in self.short:
            item = before + self.texts[i] + behind
            for doc in range(len(sizes)):
                at = (b" " + data[offsets[doc] : offsets[doc + 1]].tobytes() + b" ").find(item)
                if at >= 0:
                    best[doc, i] = (0, at + len(before + self.texts[i]) - 1)
        return [(doc, i, *v) for (doc, i), v in sorted(best.items())]


def blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[list, list]]:
    """Ids and texts of items in blocks of about BLOCK_BYTES; items come to the driver block by block."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        ids.append(r.k)
        texts.append(r.t)
        size += len(r.t)
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, item_key, distance, end): texts that hold an item within percent of its length; end is in the normalised text's bytes."""
    kinds = df.schema[key].dataType.simpleString(), items.schema[item_key].dataType
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1].simpleString()}, distance bigint, `end` bigint"
    out = None
    for ids, texts in blocks(items, item_key, item_text):
        block = df.sparkSession.sparkContext.broadcast(Items(ids, texts, percent))

        def work(keys: pa.Array, texts: pa.Array, block=block):
            got = block.value.matches(texts)
            if got:
                docs, found, d, end = zip(*got, strict=True)
                arrays = [keys.take(pa.array(docs)), pa.array([block.value.ids[i] for i in found], _arrow(kinds[1])), pa.array(d, pa.int64()), pa.array(end, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, item_key, "distance", "end"])

        one = map_texts(df, key, text, work, schema)
        out = one if out is None else out.unionByName(one)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE_SQL: dict[str, str] = {}
