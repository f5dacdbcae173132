"""N-gram Jaccard join by T-occurrence search (operator 9).

Texts become sets of word-shingle codes; equal sets are one class, and only classes are joined. Two sets of sizes m and n link
when their overlap reaches T = ceil(p (m + n) / (100 + p)) for a similarity of p percent. Inverted lists are divided as in
DivideSkip: a set's rarest shingles give its short lists, as many as guarantee that any set reaching T is on one of them;
those lists are built by one exchange and merged, and the L long ones are never read: a candidate that is on at least T - L of
the short ones is probed in them by binary search, shingle by shingle, in the candidate's own sorted set.

Rarity comes from a count sketch of a fixed number of cells, whose exact sums are kept as levels on a logarithmic scale, so that
it never saturates: however large the corpus, a shingle that is frequent against a cell's mean comes last. Any order of shingles
gives the same links; a good one gives few candidates. In lists of many members, only pairs are taken that can reach T if this is
their first common shingle.

Lists are sorted by Spark and read one after the other, so a task holds one list of at most LONGEST members. Longer lists are
found by counting those shingles whose cells are that full, and are dealt to many tasks by range of shingle, size and node. A long
list, or one whose members pair off too often (a large group of near copies), isn't paired off. Each member first tries a few
others, which contracts near copies into few components; where members are left in different components, the list is cut into
blocks by size, and each pair of blocks with different components whose sizes allow links gets a local DivideSkip search that
gives a spanning set of links.

Links become components by forests of runs of edges, and alternating large and small stars over written tables where there are more. For these a spanning set of links is enough; all
links lie within components, so their numbers are counted there: blocks of each component (or of several small ones) are held
against each other, and all overlaps in a pair of blocks are counted. Defined cases: null and empty texts and
texts without words link with nothing; repeated keys link as their texts do and have a row each; texts with fewer words than
a shingle are one shingle of all words; a null key counts as none, so a component of null keys only has a null id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotweave.llm import codes
from lotweave.llm.common import BATCH_BYTES, documents, durable, importable, map_texts, release, slices, text_bytes

WORDS, PERCENT = 4, 85
#: Lists up to LONG members are paired off; longer ones if no more than TRIES pairs a member can reach T; none over LONGEST.
LONG, TRIES, LONGEST = 32, 16, 512
#: Texts whose sets a worker makes at once.
SET_BYTES = 1 << 20
SURE = 1 << 40
#: Sketches of that many tasks, or sums of them, are summed at once.
FAN_IN = 32
#: Cells in a piece of a sketch, and steps of an octave in which counts are told apart.
PIECE, STEPS = 1 << 14, 256
NAMES = ["token", "x", "y", "nx", "ny", "n", "times"]
#: Rows of lists that are handled at once, and pairs that are gathered before they are given out.
ROWS, PAIRS = 1 << 16, 1 << 17
#: Nodes of a forest that a task of components gathers.
FOREST = 1 << 18
#: How far apart in the order of sizes the members of other lists are that try each other; sets in a block of such a list.
APART, BLOCK = (1, 3, 8, 21), 512
#: Where overlaps are counted: owners' pairs up to which a shingle's are listed, and shingles of a product of matrices.
DENSE, COLUMNS = 1 << 12, 1 << 12
#: Cells of the sketch: 4 a text within these bounds. They bound what is broadcast, not what is counted.
LEAST_BITS, MOST_BITS = 12, 22


def needed(m, n, percent: int):
    """The overlap T that sets of sizes m and n need."""
    return -(-percent * (m + n) // (100 + percent))


def n_short(n, percent: int):
    """How many of a set's rarest shingles must be listed."""
    return n - -(-percent * n // 100) + 1


def _sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    data, offsets = text_bytes(texts)
    own, first = codes.words(data, offsets)
    return [codes.shingle_set(own[first[i] : first[i + 1]], words) for i in range(len(offsets) - 1)]


def _signature(s: np.ndarray) -> tuple[int, int]:
    a = np.bitwise_xor.reduce(codes.scatter(s + np.uint64(1))) if len(s) else np.uint64(0)
    b = np.add.reduce(codes.scatter(s ^ np.uint64(0x5DEECE66D))) if len(s) else np.uint64(0)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def summed(df: DataFrame, tasks: int, size: int) -> np.ndarray:
    """Exact sums of (piece int, task int, counts binary) rows by piece, FAN_IN of them at a time; `size` numbers, whatever the input."""
    importable(df.sparkSession)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(PIECE, np.int64)
        for c in table.column("counts"):
            total += levels_of(c)
        return pa.table({"piece": table.column("piece")[:1], "task": table.column("task")[:1], "counts": pa.array([squeezed(total)], pa.binary())})

    while True:
        df = df.withColumn("task", F.expr(f"task div {FAN_IN}").cast("int")).groupBy("piece", "task").applyInArrow(add, "piece int, task int, counts binary")
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    out = np.zeros(max(size, PIECE), np.int64)
    for r in df.collect():  # one row a piece
        out[r.piece * PIECE : (r.piece + 1) * PIECE] = levels_of(r.counts)
    return out[:size]


def squeezed(counts: np.ndarray) -> bytes:
    """Counts as bytes, with the narrowest of three widths in front."""
    kind = next(k for k in ("u1", "u4", "u8") if counts.max() < 1 << 8 * int(k[1]) or k == "u8")
    return kind[1].encode() + counts.astype(kind).tobytes()


def levels_of(squeezed) -> np.ndarray:
    b = squeezed if isinstance(squeezed, bytes | bytearray) else squeezed.as_buffer()
    return np.frombuffer(b, f"u{bytes(b[:1]).decode()}", offset=1).astype(np.int64)


def counted(df: DataFrame, column: str, bits: int, cells) -> np.ndarray:
    """Exact counts of all cells(batch column) of df[column]: each task counts its own first."""
    importable(df.sparkSession)
    size = 1 << bits

    def run(batches):
        from pyspark import TaskContext

        total, some = np.zeros(max(size, PIECE), np.uint32), [np.zeros(0, np.int64)]

        def add():
            cell, n = np.unique(np.concatenate(some), return_counts=True)
            some[:] = some[:1]
            total[cell] += n.astype(np.uint32)

        for batch in batches:
            for part in slices(batch, 0, BATCH_BYTES >> 1):
                for c in cells(part.column(0)):
                    some.append(c)
                if sum(map(len, some)) > 1 << 18:
                    add()
                release()
        add()
        for k in range(0, len(total), PIECE):
            if total[k : k + PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // PIECE], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([squeezed(total[k : k + PIECE])], pa.binary())], names=["piece", "task", "counts"])

    chosen = df.select(column)
    return summed(chosen.mapInArrow(run, "piece int, task int, counts binary"), chosen.rdd.getNumPartitions(), size)


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale, as 16-bit numbers."""
    return np.minimum(np.rint(np.log2(counts + 1.0) * STEPS), 65535).astype(np.uint16)


FILTER_BITS = 22


def marked(df: DataFrame, column: str) -> np.ndarray:
    """A filter of 2 ** FILTER_BITS bits that holds all values of a bigint column, by their leading bits once scattered (a: as it is)."""
    spread = (lambda v: v) if column == "a" else codes.scatter
    cells = lambda a: [(spread(np.asarray(a).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
    return np.packbits(counted(df.select(column), column, FILTER_BITS, cells) > 0)


def only_marked(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets whose node may be among nodes: what isn't needed leaves before it is exchanged."""
    marks = sets.sparkSession.sparkContext.broadcast(marked(nodes, "node"))

    def run(batches):
        for b in batches:
            cell = (codes.scatter(np.asarray(b.column(0)).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            yield b.filter(pa.array((marks.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)))

    return sets.mapInArrow(run, sets.schema)


def shingled(df: DataFrame, key: str, text: str, words: int, percent: int, longest: int) -> DataFrame:
    """(key, n, a, b, short, full): the set's size, its signature, its rarest shingles in order, and which of them may be in over `longest` sets."""
    rows = df.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * rows).bit_length()))
    shift = np.uint64(64 - bits)

    def cells(texts):
        yield np.concatenate([(s >> shift).astype(np.int64) for s in _sets(texts, words)] or [np.zeros(0, np.int64)])

    sketch = df.sparkSession.sparkContext.broadcast(levels(counted(df.select(F.col(text).alias("_t")), "_t", bits, cells)))  # 2 << MOST_BITS bytes at most
    most = int(levels(np.array([longest]))[0])
    kind = df.schema[key].dataType.simpleString()

    def work(keys: pa.Array, texts: pa.Array):
        out, rare, full = [], [], []
        for s in _sets(texts, words):
            level = sketch.value[(s >> shift).astype(np.int64)]
            order = np.lexsort((s, level))[: n_short(len(s), percent)] if len(s) else np.zeros(0, np.int64)
            out.append((len(s), *_signature(s)))
            rare.append(s[order].view(np.int64))
            full.append(level[order] >= most)
        ends = np.cumsum([0, *map(len, rare)])
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (rare, full)]
        arrays = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([keys, *arrays, *lists], names=["id", "n", "a", "b", "short", "full"])

    return map_texts(df, key, text, work, f"id {kind}, n bigint, a bigint, b bigint, short array<bigint>, full array<boolean>", limit=SET_BYTES)


def whole_lists(batches, rows: int):
    """Arrays (token, node, n, at) of some whole lists at a time, from batches that are sorted by token."""
    carry, size = [], 0
    for b in batches:
        if not len(b):
            continue
        carry.append(np.stack([np.asarray(c) for c in b.columns]))
        size += len(b)
        if size < rows:
            continue
        every = np.concatenate(carry, 1)
        last = int(np.searchsorted(every[0], every[0, -1]))  # the last list may go on in the next batch
        if last:
            yield every[:, :last]
        carry, size = [every[:, last:].copy()], every.shape[1] - last
    if size:
        yield np.concatenate(carry, 1)


class Pairs:
    """Gathers rows of NAMES: pairs, summed by their nodes, and members."""

    def __init__(self):
        self.some: list[np.ndarray] = []
        self.size = 0

    def add(self, x, y, nx, ny, times: int) -> None:
        turned = x > y
        x, y, nx, ny = np.where(turned, y, x), np.where(turned, x, y), np.where(turned, ny, nx), np.where(turned, nx, ny)
        self.some.append(np.stack([x, y, nx, ny, np.full(len(x), times)]))
        self.size += len(x)

    def rows(self) -> pa.RecordBatch:
        x, y, nx, ny, times = np.concatenate(self.some, 1)
        self.__init__()
        order = np.lexsort((y, x))
        x, y, nx, ny, times = x[order], y[order], nx[order], ny[order], times[order]
        new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, np.int64)
        sums = np.add.reduceat(times, new) if len(x) else times
        none = pa.nulls(len(new), pa.int64())
        return pa.RecordBatch.from_arrays([none, *map(pa.array, (x[new], y[new], nx[new], ny[new])), none, pa.array(sums)], names=NAMES)

    @staticmethod
    def members(token, node, n, very: int) -> pa.RecordBatch:
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(node), none, none, none, pa.array(n), pa.array(np.full(len(token), very))], names=NAMES)


def tried(node, n, percent: int, pairs: Pairs) -> None:
    """Adds the pairs that members of one list, in order of size, try: with those APART from them."""
    for d in APART:
        u, v, m, k = node[:-d], node[d:], n[:-d], n[d:]
        near = (100 * m >= percent * k) & (u != v)
        pairs.add(u[near], v[near], m[near], k[near], SURE)


def candidates(lists: DataFrame, percent: int, long: int) -> DataFrame:
    """From (token, node, n, at) rows: pairs (x, y, nx, ny, times) and members (token, x, n, times).

    times is how many lists of up to `long` members a pair shares, or SURE if it is a candidate anyhow; of a member it is 1 if its
    list is very long or pairs off too often, and else 0. A task has whole lists, which are of LONGEST members at most.
    """

    def run(batches):
        pairs = Pairs()
        for token, node, n, at in whole_lists(batches, ROWS):
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(first, len(token)))

            def similar(p, q, node=node, n=n):
                """Whether members p and q (p's set not larger) have sizes that let them link."""
                return (100 * n[p] >= percent * n[q]) & (node[p] != node[q])

            for length in np.unique(size[(size > 1) & (size <= long)]):  # all lists of one length at once
                starts = first[size == length]
                i, j = np.triu_indices(length, 1)
                per = max(1, PAIRS // len(i))
                for k in range(0, len(starts), per):
                    s = starts[k : k + per, None]
                    p, q = (s + i).ravel(), (s + j).ravel()
                    good = similar(p, q)
                    p, q = p[good], q[good]
                    pairs.add(node[p], node[q], n[p], n[q], 1)
                    if pairs.size > PAIRS:
                        yield pairs.rows()
            for s, length in zip(first[size > long], size[size > long], strict=True):
                p = np.arange(s, s + length)
                i, j = np.triu_indices(length, 1)
                # If this is their first common shingle, what follows it bounds the overlap.
                good = similar(p[i], p[j]) & (np.minimum((n - at)[p[i]], (n - at)[p[j]]) >= needed(n[p[i]], n[p[j]], percent))
                very = good.sum() > TRIES * length
                if very:
                    tried(node[p], n[p], percent, pairs)
                else:
                    p, q = p[i[good]], p[j[good]]
                    pairs.add(node[p], node[q], n[p], n[q], SURE)
                yield pairs.members(token[s : s + length], node[s : s + length], n[s : s + length], int(very))
                if pairs.size > PAIRS:
                    yield pairs.rows()
        if pairs.some:
            yield pairs.rows()
        release()

    importable(lists.sparkSession)
    return lists.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(run, ", ".join(f"{c} bigint" for c in NAMES))


def tries(lists: DataFrame, percent: int) -> DataFrame:
    """candidates() for lists of any length, which are split over tasks: members, and the pairs that they try."""

    def run(batches):
        pairs = Pairs()
        for b in batches:
            if not len(b):
                continue
            token, node, n, _ = [np.asarray(c) for c in b.columns]
            yield pairs.members(token, node, n, 1)
            edges = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            for s, e in zip(edges, np.append(edges[1:], len(token)), strict=True):
                tried(node[s:e], n[s:e], percent, pairs)
            if pairs.size > PAIRS:
                yield pairs.rows()
        if pairs.some:
            yield pairs.rows()

    importable(lists.sparkSession)
    order = ["token", "n", "node"]
    return lists.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, ", ".join(f"{c} bigint" for c in NAMES))


def worth_checking(found: DataFrame, percent: int) -> DataFrame:
    """(x, y, times) of the pairs that are on enough short lists.

    Of two sets that reach T, one's listed shingles that the other has are all listed of both; so they share at least T - L short
    lists, L being the larger set's number of unlisted shingles. Lists that weren't paired off in full count in their favour.
    """
    pairs = found.where("y is not null").groupBy("x", "y").agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.sum("times").alias("times"))
    least = needed_column(F.col("nx") + F.col("ny"), percent)
    unlisted = F.greatest(F.col("nx"), F.col("ny"))
    unlisted = unlisted - (unlisted - F.ceil(percent * unlisted / 100.0) + 1)
    spare = found.where("y is null").groupBy(F.col("x").alias("node")).agg(F.count("*").alias("spare"))
    pairs = pairs.withColumn("lacks", least - unlisted - F.col("times"))
    sure = pairs.where("lacks <= 0")
    rest = pairs.where("lacks > 0").join(spare.select(F.col("node").alias("x"), F.col("spare").alias("sx")), "x").join(spare.select(F.col("node").alias("y"), F.col("spare").alias("sy")), "y")
    return sure.select("x", "y", "times").unionByName(rest.where("lacks <= least(sx, sy)").select("x", "y", "times"))


def needed_column(both, percent: int):
    return F.ceil(percent * both / (100.0 + percent) - 1e-9)


def overlap(s: np.ndarray, t: np.ndarray) -> int:
    """How many shingles of the smaller set the other has, by binary search."""
    if len(s) > len(t):
        s, t = t, s
    return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())


def checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (x, y) pairs that link; sets: (node, items)."""
    left = sets.select(F.col("node").alias("x"), F.col("items").alias("xs"))
    right = sets.select(F.col("node").alias("y"), F.col("items").alias("ys"))

    def run(batches):
        for b in batches:
            good = []
            for xs, ys in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(xs.as_buffer(), np.uint64), np.frombuffer(ys.as_buffer(), np.uint64)
                good.append(overlap(s, t) >= needed(len(s), len(t), percent))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["x", "y"]).filter(pa.array(good, pa.bool_()))

    met = pairs.join(left, "x").join(right, "y").select("x", "y", "xs", "ys")
    return met.mapInArrow(run, "x bigint, y bigint")


class Inverted:
    """Inverted lists of some sets, for DivideSkip searches."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.items, self.owner = every[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def search(self, query: np.ndarray, percent: int, skip: np.ndarray | None = None) -> list[int]:
        """Numbers of the sets that link with query, leaving out those where skip is true.

        The query's lists are divided: its L longest aren't merged. The others are (a stable sort merges their sorted runs),
        and a set on at least T - L of them is probed in the long ones by binary search.
        """
        fit = 100 * np.minimum(self.sizes, len(query)) >= percent * np.maximum(self.sizes, len(query))
        if skip is not None:
            fit &= ~skip
        if not fit.any():
            return []
        first, last = np.searchsorted(self.items, query), np.searchsorted(self.items, query, side="right")
        length = last - first
        order = np.argsort(length, kind="stable")
        need = needed(len(query), self.sizes, percent)
        n_long = min(int(need[fit].min()) - 1, len(query) - 1) * 3 // 4
        short = order[: len(order) - n_long]
        a, k = first[short], length[short]
        at = np.arange(k.sum()) + np.repeat(a - np.append(0, np.cumsum(k)[:-1]), k)
        merged = np.sort(self.owner[at], kind="stable")
        starts = np.flatnonzero(np.append(True, merged[1:] != merged[:-1])) if len(merged) else np.zeros(0, np.int64)
        who, times = merged[starts], np.diff(np.append(starts, len(merged)))
        some = who[fit[who] & (times >= np.maximum(1, need[who] - n_long))]
        return [int(k) for k in some if overlap(query, self.sets[k]) >= need[k]]


def stars(edges: DataFrame) -> DataFrame:
    """(node, root): components of (x, y) edges; root is a component's least node.

    Each task reduces runs of edges to forests first. Edges that fit in one run are done by that; others go by alternating large
    and small stars: each node points its larger neighbours to the least of its neighbourhood, then its smaller ones. As soon as
    what is left fits in one run, a last forest ends it. The rounds' many small exchanges are thus for large inputs only.
    """
    importable(edges.sparkSession)
    run = FOREST // 2  # edges of a run, whose nodes are within FOREST

    def forest(batches):
        root: dict[int, int] = {}

        def find(u):
            while root.setdefault(u, u) != u:
                root[u] = root[root[u]]
                u = root[u]
            return u

        def kept():
            some = [(u, find(u)) for u in root if find(u) != u]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in some], pa.int64()), pa.array([v for _, v in some], pa.int64())], names=["u", "v"])

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, c = find(u), find(v)
                if a != c:
                    root[max(a, c)] = min(a, c)
                if len(root) > 2 * run:
                    yield kept()
        yield kept()

    def forests(e: DataFrame, n: int) -> DataFrame:
        """A forest of each run of n edges in all."""
        return e.coalesce(-(-n // run) or 1).mapInArrow(forest, "u bigint, v bigint")

    edges = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v")
    n = edges.count()
    if n > run:
        edges = durable(forests(edges, n).distinct())
    seen = None
    while n > run:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        n = mark[0]
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        if n <= run:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("w"), "m").where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v"))
        edges = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return durable(forests(edges, n)).select(F.col("u").alias("node"), F.col("v").alias("root"))


def long_lists(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame | None:
    """Links between members of long lists that are still in different components; members: (token, node, n).

    Sizes are cut into bands so wide that only sets of one band or of neighbouring ones can link; blocks lie within a band.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int")
    labelled = durable(members.withColumn("band", band).join(roots, "node", "left").select("token", "node", "band", F.coalesce("root", "node").alias("label")).distinct())
    per = labelled.groupBy("token", "band", "label").agg(F.count("*").alias("c"))
    open_ = durable(per.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token"))
    if not open_.limit(1).count():
        return None
    per = durable(per.join(open_, "token"))
    total = per.groupBy("token", "band").agg(F.sum("c").alias("total"))
    # Large components get blocks of their own, small ones share some.
    sized = labelled.join(per, ["token", "band", "label"]).join(total, ["token", "band"])
    own = F.concat(F.lit("c"), F.col("label"), F.lit("/"), F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / block)))
    dealt = durable(sized.select("token", "band", "node", "label", F.when(F.col("c") >= block, own).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("label"), F.ceil(F.col("total") / block)))).alias("block")))
    blocks = durable(dealt.groupBy("token", "band", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")))
    other = blocks.select("token", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("band").alias("band2"), F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    cells = blocks.join(other, ["token", "band"]).where("band < band2 or block <= block2").where("least(lo, lo2) < greatest(hi, hi2)")
    # Equal cells of several lists (the same near copies) are searched once.
    sides = F.array(F.struct("band", "block"), F.struct(F.col("band2").alias("band"), F.col("block2").alias("block")))
    cells = cells.select("token", F.concat_ws("|", "band", "block", "band2", "block2").alias("cell"), F.explode(F.array_distinct(sides)).alias("side")).select("token", "cell", "side.*")
    asked = durable(cells.join(dealt, ["token", "band", "block"]))
    rows = asked.join(only_marked(sets, asked.select("node")), "node").select("token", "cell", "node", "label", "items")

    def search(table: pa.Table) -> pa.Table:
        node = np.asarray(table.column("node"))
        items = [np.frombuffer(c.as_buffer(), np.uint64) for c in table.column("items")]
        index = Inverted(items)
        name, label, times = np.unique(np.asarray(table.column("label")), return_inverse=True, return_counts=True)
        xs, ys = [], []
        # Each pair of different components has a member outside the most frequent one.
        for q in np.flatnonzero(label != times.argmax()):
            for k in index.search(items[q], percent, label == label[q]):
                if label[k] != label[q]:
                    xs.append(min(node[k], node[q]))
                    ys.append(max(node[k], node[q]))
                    label[label == label[k]] = label[q]
        return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

    return rows.groupBy("token", "cell").applyInArrow(search, "x bigint, y bigint")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of left shares with each set of right."""
    a, b = np.concatenate(left), np.concatenate(right)
    both, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    own = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    times = [np.bincount(x, minlength=len(both)) for x in (of[: len(a)], of[len(a) :])]
    out = np.zeros((len(left), len(right)), np.int64)
    # Rare shingles: pairs of their owners, one by one.
    rare = (times[0] > 0) & (times[1] > 0) & (times[0] * times[1] <= DENSE)
    sides = []
    for x, o in zip((of[: len(a)], of[len(a) :]), own, strict=True):
        order = np.argsort(x, kind="stable")
        sides.append((o[order], np.searchsorted(x[order], np.arange(len(both)))))
    (p, first_p), (q, first_q) = sides
    some = np.flatnonzero(rare)
    pairs = times[0][some] * times[1][some]
    total = np.append(0, np.cumsum(pairs))
    k = 0
    while k < len(some):
        m = max(k + 1, int(np.searchsorted(total, total[k] + (1 << 20), side="right")) - 1)
        at = np.repeat(some[k:m], pairs[k:m])
        number = np.arange(total[k], total[m]) - np.repeat(total[k:m], pairs[k:m])
        u, v = p[first_p[at] + number // times[1][at]], q[first_q[at] + number % times[1][at]]
        out += np.bincount(u * len(right) + v, minlength=out.size).reshape(out.shape)
        k = m
    # Others: products of 0/1 matrices, some shingles at a time (exact: sums stay below 2 ** 24).
    column = np.full(len(both), -1)
    many = np.flatnonzero((times[0] > 0) & (times[1] > 0) & ~rare)
    column[many] = np.arange(len(many))
    for k in range(0, len(many), COLUMNS):
        found = []
        for x, o, n in ((of[: len(a)], own[0], len(left)), (of[len(a) :], own[1], len(right))):
            good = (column[x] >= k) & (column[x] < k + COLUMNS)
            table = np.zeros((n, min(COLUMNS, len(many) - k)), np.float32)
            table[o[good], column[x[good]] - k] = 1
            found.append(table)
        out += (found[0] @ found[1].T).astype(np.int64)
    return out


def link_counts(roots: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(node, n_links): with how many others each node of a component links; roots: (node, root) of all nodes but the roots."""
    sized = durable(roots.groupBy("root").agg((F.count("*") + 1).alias("c")))
    nodes = roots.select("node", "root").unionByName(sized.select(F.col("root").alias("node"), "root")).join(sized, "root")
    alone = nodes.where("c = 2").select("node", F.lit(1).cast("bigint").alias("n_links"))  # a pair is one link
    small = sized.where(F.col("c").between(3, block)).agg(F.sum("c")).first()[0] or 0
    bundles = -(-small // block) or 1
    own = F.when(F.col("c") > block, F.col("root")).otherwise(-1 - F.pmod(F.xxhash64("root"), F.lit(bundles)))
    n = F.when(F.col("c") > block, F.ceil(F.col("c") / block)).otherwise(F.lit(1)).cast("int")
    dealt = durable(nodes.where("c > 2").select("node", own.alias("own"), n.alias("n")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")))
    met = only_marked(sets, dealt.select("node")).join(dealt, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = met.select("own", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "items")

    def count(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.unique(np.asarray(table.column("node")), return_index=True)[1]))  # equal rows give a set twice
        node, part = np.asarray(table.column("node")), np.asarray(table.column("part"))
        items = [np.frombuffer(c.as_buffer(), np.uint64) for c in table.column("items")]
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sides = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        if not len(sides[0]) or not len(sides[1]):
            return pa.table({"node": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})
        size = [np.array([len(items[k]) for k in side], np.int64) for side in sides]
        links = overlaps(*[[items[k] for k in side] for side in sides]) >= needed(size[0][:, None], size[1][None, :], percent)
        if lo == hi:
            np.fill_diagonal(links, False)
            out = node, links.sum(1)
        else:
            out = np.concatenate([node[s] for s in sides]), np.concatenate([links.sum(1), links.sum(0)])
        release()
        return pa.table({"node": pa.array(out[0], pa.int64()), "n_links": pa.array(out[1], pa.int64())})

    some = cells.groupBy("own", "lo", "hi").applyInArrow(count, "node bigint, n_links bigint")
    return some.groupBy("node").agg(F.sum("n_links").alias("n_links")).unionByName(alone)


def components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, long: int = LONG, block: int = BLOCK, count: bool = True) -> DataFrame:
    """(key, n_shingles, component_id, n_links): a row for each of df's rows.

    n_links counts the other classes of equal sets that the row's own class links with, all of them; count=False leaves it out.
    """
    spark = df.sparkSession
    importable(spark)
    docs = durable(shingled(df, key, text, words, percent, LONGEST))
    classes = docs.where("n > 0").groupBy("n", "a", "b").agg(F.min("id").alias("least"), F.first(F.arrays_zip("short", "full")).alias("short"))
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()))
    lists = classes.select(F.posexplode("short").alias("at", "s"), "node", "n").select("s.short", "node", "n", F.col("at").cast("bigint"), "s.full").withColumnRenamed("short", "token")
    full = lists.where("full").drop("full")
    hot = durable(full.groupBy("token").agg(F.count("*").alias("size")).where(F.col("size") > LONGEST).select("token"))
    lists = lists.drop("full")
    if hot.limit(1).count():
        found = durable(candidates(lists.join(hot, "token", "left_anti"), percent, long).unionByName(tries(full.join(hot, "token", "left_semi"), percent)))
    else:
        found = durable(candidates(lists, percent, long))
    pairs = durable(worth_checking(found, percent))
    members = found.where("y is null and times = 1").select("token", F.col("x").alias("node"), "n")
    # Sets of the nodes that are asked for: texts are read again, and a fixed-size filter by signature spares most of them.
    asked = pairs.select(F.explode(F.array("x", "y")).alias("node")).unionByName(members.select("node")).distinct()
    asked = durable(classes.select("node", "n", "a", "b", "least").join(asked, "node"))
    marks = marked(asked, "a")
    chosen = spark.sparkContext.broadcast(marks)

    def items(keys: pa.Array, texts: pa.Array):
        out, at = [], []
        for k, s in enumerate(_sets(texts, words)):
            a, b = _signature(s)
            cell = (a & (1 << 64) - 1) >> 64 - FILTER_BITS
            if len(s) and chosen.value[cell >> 3] >> 7 - (cell & 7) & 1:
                at.append(k)
                out.append((len(s), a, b, s.tobytes()))
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())], names=["id", "n", "a", "b", "items"])

    kind = df.schema[key].dataType.simpleString()
    some = map_texts(df, key, text, items, f"id {kind}, n bigint, a bigint, b bigint, items binary", limit=SET_BYTES).withColumnRenamed("id", "_id")
    # One text speaks for a class (or equal rows of it do, which find the same links).
    sets = durable(some.join(asked, ["n", "a", "b"]).where(F.col("_id").eqNullSafe(F.col("least"))).select("node", "items"))
    # The pair of each set that shares most lists comes first; that leaves few others between different components.
    best = Window.partitionBy("x").orderBy(F.desc("times"), "y")
    ranked = pairs.withColumn("first", F.row_number().over(best) == 1)
    links = durable(checked(ranked.where("first").select("x", "y"), sets, percent))
    roots = stars(links)
    label = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    rest = ranked.where("not first").join(label("x"), "x", "left").join(label("y"), "y", "left")
    rest = durable(rest.where(F.coalesce("root_x", "x") != F.coalesce("root_y", "y")).select("x", "y"))
    links = durable(links.unionByName(checked(rest, only_marked(sets, rest.select(F.explode(F.array("x", "y")).alias("node"))), percent)))
    roots = stars(links)
    more = long_lists(members, roots, sets, percent, block)
    if more is not None:
        links = durable(links.unionByName(more.distinct()))
        roots = stars(links)
    named = classes.select("node", "n", "a", "b", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root")
    numbers = []
    if count:
        numbers = ["n_links"]
        named = named.join(durable(link_counts(roots, sets, percent, block)), "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    named = durable(named.select("n", "a", "b", "component_id", *numbers))
    met = docs.where("n > 0").select("id", "n", "a", "b").join(named, ["n", "a", "b"]).select("id", "n", "component_id", *numbers)
    alone = docs.where("n = 0").select("id", "n", F.col("id").alias("component_id"), *[F.lit(0).cast("bigint").alias(c) for c in numbers])
    return met.unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", *numbers)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
