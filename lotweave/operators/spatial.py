"""Spatial joins by grid cells, clustering, adjacency and grouped geometry.

Points and boxes are joined by the cells of a grid they share, so that a join is an equi-join on cells whose size follows
from the distance asked for; the exact test comes after. Only kernels on one group (a parcel, a unit, a district) use Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotweave.geometry import overlay, projection, shapes
from lotweave.operators.tables import written


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def near_cells(x: Column, y: Column, size: float) -> Column:
    """The nine cells around a point."""
    step = F.array(*map(F.lit, (-1, 0, 1)))
    return F.flatten(F.transform(step, lambda i: F.transform(step, lambda j: F.struct((cell(x, size) + i).alias("i"), (cell(y, size) + j).alias("j")))))


def within_distance(left: DataFrame, right: DataFrame, distance: float, by: str | None = None) -> DataFrame:
    """Pairs (id, other, d) of points at most `distance` apart, and of the same `by`; both sides (id, x, y, by)."""
    also = [by] if by else []
    a = left.select("id", "x", "y", *also, F.explode(near_cells(F.col("x"), F.col("y"), distance)).alias("c")).select("*", "c.i", "c.j").drop("c")
    b = right.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), *also, cell(F.col("x"), distance).alias("i"), cell(F.col("y"), distance).alias("j"))
    d = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2)
    return a.join(b, [*also, "i", "j"]).withColumn("d", d).where(F.col("d") <= distance).select("id", "other", "d")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Pairs (id, box) of points inside boxes (box, minx, miny, maxx, maxy), edges included, over a grid of cells of `size`."""
    span = lambda lo, hi: F.sequence(cell(F.col(lo), size), cell(F.col(hi), size))
    b = boxes.select("*", F.explode(span("minx", "maxx")).alias("i")).select("*", F.explode(span("miny", "maxy")).alias("j"))
    p = points.select("id", "x", "y", cell(F.col("x"), size).alias("i"), cell(F.col("y"), size).alias("j"))
    inside = F.col("x").between(F.col("minx"), F.col("maxx")) & F.col("y").between(F.col("miny"), F.col("maxy"))
    return p.join(b, ["i", "j"]).where(inside).select("id", "box")


def first_box(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """points with the first box that holds them, or none: a left join with one match a point."""
    hit = points_in_boxes(points, boxes, size).groupBy("id").agg(F.min("box").alias("box"))
    return points.join(hit, "id", "left")


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Pairs (id, box) of points inside polygons (box, minx, miny, maxx, maxy, geom as WKB); those on an edge are not inside.

    Points are tested by polygon, as many at once as a batch has of it.
    """
    found = points_in_boxes(points, polygons.drop("geom"), size).join(points, "id").join(polygons.select("box", "geom"), "box")
    return held(found)


def held(found: DataFrame) -> DataFrame:
    """Pairs (id, box) of rows (id, box, x, y, geom as WKB of the box) whose point lies inside; those on an edge don't."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            at = np.stack([np.asarray(b.column(2)), np.asarray(b.column(3))], 1)
            of = np.asarray(b.column(1).dictionary_encode().indices)
            order = np.argsort(of, kind="stable")
            good = np.zeros(len(b), bool)
            for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                for p in shapes.from_wkb(b.column(4)[int(rows[0])].as_py()):
                    good[rows] |= shapes.contains(p, at[rows]) & ~shapes.on_edge(p, at[rows])
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["id", "box"]).filter(pa.array(good))

    kind = dict(found.dtypes)
    return found.select("id", "box", F.col("x").cast("double"), F.col("y").cast("double"), "geom").mapInArrow(run, f"id {kind['id']}, box {kind['box']}")


def nearest(points: DataFrame, sites: DataFrame, start: float, by: str | None = None) -> DataFrame:
    """(id, other, d): the nearest site of each point (of the same `by`), the least id on ties.

    The search distance doubles each time, for the points that have no site yet only.
    """
    also = [by] if by else []
    left = points.select("id", "x", "y", *also).where("x is not null and y is not null")
    left = left.join(sites.select(*also).distinct(), by, "left_semi") if by else left
    out, distance = None, start
    if not sites.limit(1).count():
        return within_distance(points, sites, start, by)
    while True:
        pairs = within_distance(left, sites, distance, by)
        best = written(pairs.groupBy("id").agg(F.min(F.struct("d", "other")).alias("b")).select("id", F.col("b.other").alias("other"), F.col("b.d").alias("d")))
        out = best if out is None else out.unionByName(best)
        left = written(left.join(best.select("id"), "id", "left_anti"))
        if not left.limit(1).count():
            return out
        distance *= 2


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) of all nodes: the least id of a node's component; edges: (id, other).

    Labels go to neighbours and then jump to their label's label, so the number of rounds is logarithmic in practice. Each
    round is a written table.
    """
    both = written(edges.select("id", "other").unionByName(edges.select(F.col("other").alias("id"), F.col("id").alias("other"))).where("id <> other").distinct())
    labels = written(nodes.select("id").distinct().withColumn("root", F.col("id")))
    while True:
        around = both.join(labels.select(F.col("id").alias("other"), F.col("root").alias("r")), "other").groupBy("id").agg(F.min("r").alias("r"))
        hooked = labels.join(around, "id", "left").select("id", "root", F.least("root", F.coalesce("r", "root")).alias("new"))
        # A root takes the least label that any member of its tree has seen.
        best = hooked.groupBy("root").agg(F.min("new").alias("best"))
        hooked = written(hooked.join(best, "root").select("id", "root", "best"))
        jump = hooked.select(F.col("id").alias("best"), F.col("best").alias("further"))
        new = written(hooked.join(jump, "best").select("id", F.col("root").alias("old"), F.col("further").alias("root")))
        if not new.where("old <> root").limit(1).count():
            return new.select("id", "root")
        labels = new.select("id", "root")


def linked_clusters(points: DataFrame, group: str, link: float) -> DataFrame:
    """(id, root): single-link clusters of points of one group at most `link` apart; points: (id, group, x, y)."""
    return components(points, within_distance(points, points, link, group).where("id < other").select("id", "other"))


def detached(points: DataFrame, clusters: DataFrame, group: str, gap: float, cells: float) -> DataFrame:
    """(group, root, n, d): clusters of a unit but its largest (ties: the one with the least id) whose least distance to it is `gap` or more."""
    m = points.join(clusters, "id")
    size = m.groupBy(group, "root").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "root"))
    ranked = size.withColumn("rank", rank)
    main = ranked.where("rank = 1").select(group, F.col("root").alias("main"))
    own = m.join(main, group)
    columns = ["id", "x", "y", group]
    found = nearest(own.where("root <> main").select(*columns), own.where("root = main").select(*columns), cells, group)
    d = found.join(m.select("id", group, "root"), "id").groupBy(group, "root").agg(F.min("d").alias("d"))
    return d.where(F.col("d") >= gap).join(size, [group, "root"]).select(group, "root", "n", "d")


def omissions(candidates: DataFrame, assigned: DataFrame, distance: float = 15.0, share: float = 0.8) -> DataFrame:
    """(id, tong, n): unassigned points most of whose assigned neighbours are of one unit."""
    met = within_distance(candidates, assigned, distance).join(assigned.select(F.col("id").alias("other"), "tong"), "other")
    n = met.groupBy("id", "tong").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("id"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "tong"))
    return n.withColumn("_t", total).withColumn("_r", best).where((F.col("_r") == 1) & (F.col("n") >= share * F.col("_t"))).select("id", "tong", "n")


def box_pairs(boxes: DataFrame, distance: float, size: float) -> DataFrame:
    """Pairs (box, other), box < other, of boxes at most `distance` apart."""
    half = distance / 2
    span = lambda lo, hi: F.sequence(cell(F.col(lo) - half, size), cell(F.col(hi) + half, size))
    b = boxes.select("*", F.explode(span("minx", "maxx")).alias("i")).select("*", F.explode(span("miny", "maxy")).alias("j"))
    c = b.select(*[F.col(x).alias(f"o_{x}") for x in ("box", "minx", "miny", "maxx", "maxy")], "i", "j")
    dx = F.greatest(F.lit(0.0), F.col("o_minx") - F.col("maxx"), F.col("minx") - F.col("o_maxx"))
    dy = F.greatest(F.lit(0.0), F.col("o_miny") - F.col("maxy"), F.col("miny") - F.col("o_maxy"))
    return b.join(c, ["i", "j"]).where((F.col("box") < F.col("o_box")) & (F.sqrt(dx * dx + dy * dy) <= distance)).select("box", F.col("o_box").alias("other")).distinct()


def coverage(blocks: DataFrame, parcels: DataFrame, least_n: int = 2, least_share: float = 0.10) -> DataFrame:
    """(block, n, share): blocks whose parcels are enough and cover enough of it; parcels: (block, area)."""
    sums = parcels.groupBy("block").agg(F.count("*").alias("n"), F.sum("area").alias("_a"))
    return blocks.join(sums, "block").withColumn("share", F.col("_a") / F.col("area")).where((F.col("n") >= least_n) & (F.col("share") >= least_share)).select("block", "n", "share")


def _rings(table: pa.Table, column: str = "geom") -> list[list[list[np.ndarray]]]:
    return [shapes.from_wkb(g) for g in table.column(column).to_pylist()]


def dissolve(parcels: DataFrame, key: str) -> DataFrame:
    """(key, area, rings): the union of each key's tiling polygons."""

    def run(table: pa.Table) -> pa.Table:
        parts = [p for g in _rings(table) for p in g]
        rings = shapes.dissolve([p[0] for p in parts], holes=[h for p in parts for h in p[1:]])
        return pa.table({key: table.column(key).slice(0, 1), "area": pa.array([sum(map(shapes.ring_area, rings))], pa.float64()), "rings": pa.array([len(rings)], pa.int32())})

    return parcels.groupBy(key).applyInArrow(run, f"`{key}` {dict(parcels.dtypes)[key]}, area double, rings int")


def voronoi_split(parcels: DataFrame, sites: DataFrame, key: str, least: float = 5.0) -> DataFrame:
    """(key, label, area, geom): each key's land cut into the parts nearest to its sites, united by label; united parts under `least` go.

    parcels: (key, geom), which may have holes; several of a key are united first. sites: (key, label, x, y); of sites at one
    place the least label's counts.
    """
    kinds = dict(parcels.dtypes)[key], dict(sites.dtypes)["label"]

    def run(p: pa.Table, s: pa.Table) -> pa.Table:
        rows = []
        if len(p) and len(s):
            s = s.sort_by([(c, "ascending") for c in ("label", "x", "y")])
            at, labels = np.stack([np.asarray(s.column("x")), np.asarray(s.column("y"))], 1), s.column("label").to_pylist()
            land = [q for g in _rings(p) for q in g]
            land = land if len(p) == 1 else overlay.union(land)
            area: dict = {}
            rings: dict = {}
            for q in land:
                for k, r in enumerate(q):
                    for c, label in zip(shapes.voronoi(r, at), labels, strict=True):
                        if len(c) >= 3:
                            size = shapes.ring_area(c - c[0])
                            area[label] = area.get(label, 0.0) + (-abs(size) if k else abs(size))
                            rings.setdefault(label, []).append(c if (size < 0) == (k > 0) else c[::-1])
            for label in (x for x in area if area[x] >= least):
                # Parts that are all narrower than the grid stay as they are.
                g = overlay.tiled(rings[label]) or [[r] for r in rings[label] if all(len(q) == 1 for q in land)]
                if g:
                    rows.append((p.column(key)[0].as_py(), label, area[label], shapes.to_wkb(g[0]) if len(g) == 1 else shapes.to_multi(g)))
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(((key, p.schema.field(key).type), ("label", s.schema.field("label").type), ("area", pa.float64()), ("geom", pa.binary())))})

    return parcels.groupBy(key).cogroup(sites.groupBy(key)).applyInArrow(run, f"`{key}` {kinds[0]}, label {kinds[1]}, area double, geom binary")


SLOTS = 12


def color(units: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """(group, id, slot): a colour of twelve for each unit of a district, far from its neighbours' on the colour wheel.

    Greedy within a district, by falling number of neighbours and then place: the slot farthest from the used ones, then the
    least used, then the lowest. units: (group, id); pairs: (group, id, other).
    """
    kind = dict(units.dtypes)

    def run(u: pa.Table, p: pa.Table) -> pa.Table:
        ids = sorted(u.column("id").to_pylist())
        around = {i: set() for i in ids}
        for a, b in zip(p.column("id").to_pylist(), p.column("other").to_pylist(), strict=True):
            around[a].add(b)
            around[b].add(a)
        slot, used = {}, np.zeros(SLOTS, int)
        wheel = np.arange(SLOTS)
        for i in sorted(ids, key=lambda i: -len(around[i])):
            taken = np.array([slot[j] for j in around[i] if j in slot])
            gap = np.abs(wheel[:, None] - taken[None, :]) % SLOTS if len(taken) else np.full((SLOTS, 1), SLOTS)
            far = (np.minimum(gap, SLOTS - gap) if len(taken) else gap).min(1)
            slot[i] = int(np.lexsort((wheel, used, -far))[0])
            used[slot[i]] += 1
        return pa.table({group: pa.array([u.column(group)[0].as_py()] * len(ids), u.schema.field(group).type), "id": pa.array(ids, u.schema.field("id").type), "slot": pa.array([slot[i] for i in ids], pa.int32())})

    return units.groupBy(group).cogroup(pairs.groupBy(group)).applyInArrow(run, f"`{group}` {kind[group]}, id {kind['id']}, slot int")


#: Rows of roads and their neighbours that are handled at once, and sites along boundaries.
ROAD_ROWS, ROAD_SITES = 1 << 14, 1 << 17


def _spread(rings: list[np.ndarray], step: float, bounds: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places along each ring, in even steps, and how many it has; rings of as many corners go side by side."""
    found: list = [None] * len(rings)
    corners = np.array([len(r) for r in rings])
    for v in np.unique(corners):
        some = np.flatnonzero(corners == v)
        r = np.stack([rings[i] for i in some])
        closed = np.concatenate([r, r[:, :1]], 1)
        ends = np.concatenate([np.zeros((len(r), 1)), np.cumsum(np.hypot(*np.moveaxis(np.diff(closed, axis=1), 2, 0)), 1)], 1)
        times = np.clip(ends[:, -1] // step, *bounds).astype(np.int64)
        for k in np.unique(times):
            rows = np.flatnonzero(times == k)
            for i in np.array_split(rows, -(-len(rows) * k * v // (1 << 20))):
                at = np.arange(k) / k * ends[i, -1:]
                edge = (ends[i, 1:-1, None] <= at[:, None]).sum(1)
                row = np.arange(len(i))[:, None]
                a, b = ends[i[:, None], edge], ends[i[:, None], edge + 1]
                share = np.divide(at - a, b - a, out=np.zeros_like(at), where=b > a)[..., None]
                places = closed[i][row, edge] * (1 - share) + closed[i][row, edge + 1] * share
                for m, j in enumerate(some[i].tolist()):
                    found[j] = places[m]
    return np.concatenate(found) if found else np.zeros((0, 2)), np.array([len(f) for f in found], np.int64)


def split_roads(roads: DataFrame, neighbours: DataFrame, step: float = 3.0, bounds: tuple[int, int] = (12, 1200), least: float = 5.0) -> DataFrame:
    """(id, tong, fill, area): road parcels given to the units beside them.

    roads: (id, geom); neighbours: (id, tong, geom), parcels that touch the road. None: left out; one unit: road_match; several:
    the road is cut between points along the neighbours' boundaries (road_split), or goes to the least unit if that leaves
    nothing (manual_pending). Places that several units share are the least one's.

    Roads and their neighbours come sorted by road, so that many roads are cut side by side.
    """
    kind = dict(roads.dtypes)["id"]
    names = ["id", "tong", "fill", "area"]
    every = roads.select("id", F.lit(None).cast("int").alias("tong"), "geom", F.lit(0).alias("_beside"))
    every = every.unionByName(neighbours.select("id", F.col("tong").cast("int").alias("tong"), "geom", F.lit(1).alias("_beside")))

    def cut(t: pa.Table) -> pa.RecordBatch:
        """Of some roads, whole with their neighbours."""
        of = np.asarray(t.column("id").combine_chunks().dictionary_encode(null_encoding="encode").indices)
        beside, tong = np.asarray(t.column("_beside")), t.column("tong").to_pylist()
        geoms = [shapes.from_wkb(g) for g in t.column("geom").to_pylist()]
        edges = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
        rows: list[tuple] = []  # row of the road, tong, fill, area
        several = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            m = a + int((beside[a:b] == 0).sum())
            units = set(tong[m:b])
            if len(units) > 1:
                several.append((a, m, b))
            elif units:
                rows += [(r, tong[m], "road_match", sum(map(shapes.area, geoms[r]))) for r in range(a, m)]
        k = 0
        while k < len(several):
            some, n = [], 0
            rings, labels, first = [], [], []  # of the neighbours of some roads
            while k < len(several) and n < ROAD_SITES:
                a, m, b = several[k]
                first.append(len(rings))
                for j in range(m, b):
                    rings += [q[0] for q in geoms[j]]
                    labels += [tong[j]] * len(geoms[j])
                n += sum(12 if len(r) < 9 else bounds[1] for r in rings[first[-1] :]) * (m - a)
                some.append((a, m))
                k += 1
            at, times = _spread(rings, step, bounds)
            label, starts = np.repeat(np.array(labels), times), np.append(0, np.cumsum(times))
            ends = starts[np.append(first[1:], len(rings)).astype(np.int64)]
            begin = starts[np.array(first)]
            parts = [(r, q[0], i) for i, (a, m) in enumerate(some) for r in range(a, m) for q in geoms[r]]
            sums: dict[int, dict[int, float]] = {r: {} for a, m in some for r in range(a, m)}
            boxes = [x for x in parts if shapes.is_box(x[1])]
            if boxes:
                low, high = np.stack([q.min(0) for _, q, _ in boxes]), np.stack([q.max(0) for _, q, _ in boxes])
                mine = np.concatenate([np.arange(begin[i], ends[i]) for *_, i in boxes])
                group = np.repeat(np.arange(len(boxes)), [ends[i] - begin[i] for *_, i in boxes])
                size = shapes.areas_of(*shapes.nearest_parts(low, high, group, at[mine]))
                held = size > 0
                name, at_unit = np.unique(np.stack([group[held], label[mine][held]]), axis=1, return_inverse=True)
                for (g, u), area in zip(name.T.tolist(), np.bincount(at_unit, size[held]).tolist(), strict=True):
                    r = boxes[g][0]
                    sums[r][u] = sums[r].get(u, 0) + area
            for r, q, i in parts:
                if not shapes.is_box(q):
                    for c, u in zip(shapes.voronoi(q, at[begin[i] : ends[i]]), label[begin[i] : ends[i]].tolist(), strict=True):
                        if len(c) >= 3:
                            sums[r][u] = sums[r].get(u, 0) + abs(shapes.ring_area(c))
            for i, (a, m) in enumerate(some):
                for r in range(a, m):
                    found = [(r, u, "road_split", x) for u, x in sorted(sums[r].items()) if x >= least]
                    rows += found or [(r, int(label[begin[i] : ends[i]].min()), "manual_pending", sum(map(shapes.area, geoms[r])))]
        at = pa.array([r[0] for r in rows], pa.int64())
        ids = t.column("id").combine_chunks().take(at)
        return pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.float64())], names=names)

    def run(batches):
        carry, size = [], 0
        for b in batches:
            if not len(b):
                continue
            carry.append(b)
            size += len(b)
            if size < ROAD_ROWS:
                continue
            t = pa.Table.from_batches(carry)
            of = np.asarray(t.column("id").combine_chunks().dictionary_encode(null_encoding="encode").indices)
            last = int(np.flatnonzero(of != of[-1])[-1]) + 1 if (of != of[-1]).any() else 0  # the last road may go on in the next batch
            if last:
                yield cut(t.slice(0, last))
            carry, size = t.slice(last).combine_chunks().to_batches(), len(t) - last
        if size:
            yield cut(pa.Table.from_batches(carry))

    return every.repartition("id").sortWithinPartitions("id", "_beside", "tong").mapInArrow(run, f"id {kind}, tong int, fill string, area double")


def polygonize(lines: DataFrame, group: str, least: float = 1.0) -> DataFrame:
    """(group, block, area, geom): bounded faces of each district's line network; lines: (group, x1, y1, x2, y2)."""

    def run(table: pa.Table) -> pa.Table:
        found = shapes.faces(np.stack([np.asarray(table.column(c)) for c in ("x1", "y1", "x2", "y2")], 1), least=least)
        found.sort(key=lambda r: tuple(r.min(0)))
        return pa.table({
            group: pa.array([table.column(group)[0].as_py()] * len(found), table.schema.field(group).type),
            "block": pa.array(range(len(found)), pa.int32()),
            "area": pa.array([shapes.ring_area(r) for r in found], pa.float64()),
            "geom": pa.array([shapes.to_wkb([r]) for r in found], pa.binary()),
        })

    return lines.groupBy(group).applyInArrow(run, f"`{group}` {dict(lines.dtypes)[group]}, block int, area double, geom binary")


def half_plane_split(boxes: DataFrame, line: Column) -> DataFrame:
    """Boxes cut at a height: (box, part n or s, area), empty parts left out."""
    width = F.col("maxx") - F.col("minx")
    south = F.greatest(F.lit(0.0), F.least(F.col("maxy"), line) - F.col("miny")) * width
    north = F.greatest(F.lit(0.0), F.col("maxy") - F.greatest(F.col("miny"), line)) * width
    parts = F.array(F.struct(F.lit("s").alias("part"), south.alias("area")), F.struct(F.lit("n").alias("part"), north.alias("area")))
    return boxes.select("box", F.inline(parts)).where("area > 0")


def assign_blocks(blocks: DataFrame, parcels: DataFrame, size: float, least_n: int = 2, least_share: float = 0.10, least: float = 2.0) -> DataFrame:
    """(block, tong, kind, area): street blocks given to the units of the parcels in them.

    blocks: (block, area, minx, miny, maxx, maxy, geom); parcels: (id, x, y, tong, area). Blocks with few parcels are left out; one
    unit takes the whole block (single); several share it by the nearest parcel (mixed).
    """
    where = points_in_polygons(parcels.select("id", "x", "y"), blocks.select(F.col("block").alias("box"), "minx", "miny", "maxx", "maxy", "geom"), size)
    inside = where.join(parcels, "id").withColumnRenamed("box", "block")
    good = coverage(blocks.select("block", "area"), inside.select("block", "area"), least_n, least_share).select("block")
    units = inside.join(good, "block").groupBy("block").agg(F.min("tong").alias("lo"), F.max("tong").alias("hi"))
    single = units.where("lo = hi").join(blocks, "block").select("block", F.col("lo").alias("tong"), F.lit("single").alias("kind"), "area")
    several = units.where("lo < hi").select("block")
    cut = voronoi_split(blocks.join(several, "block", "left_semi").select("block", "geom"), inside.join(several, "block", "left_semi").select("block", F.col("tong").alias("label"), "x", "y"), "block", 0.0)
    mixed = cut.groupBy("block", "label").agg(F.sum("area").alias("area")).where(F.col("area") >= least)
    return single.unionByName(mixed.select("block", F.col("label").alias("tong"), F.lit("mixed").alias("kind"), "area"))


def carve(units: DataFrame, key: str, holes: DataFrame) -> DataFrame:
    """(key, geom): each unit's pieces without the convex holes (key, geom) that concern it; units without holes stay whole."""

    def run(u: pa.Table, h: pa.Table) -> pa.Table:
        pieces = [p[0] for g in _rings(u) for p in g] if len(u) else []
        for g in _rings(h) if len(h) else []:
            for hole in g:
                pieces = [r for p in pieces for r in shapes.subtract_convex(p, hole[0])]
        name = u.column(key)[0].as_py() if len(u) else None
        return pa.table({key: pa.array([name] * len(pieces), u.schema.field(key).type), "geom": pa.array([shapes.to_wkb([p]) for p in pieces], pa.binary())})

    return units.groupBy(key).cogroup(holes.groupBy(key)).applyInArrow(run, f"`{key}` {dict(units.dtypes)[key]}, geom binary")


def split_parcels(parcels: DataFrame, buildings: DataFrame) -> DataFrame:
    """Parcels (legal, lot, tong, ban, geom) with those that have buildings (legal, lot, x, y, tong) replaced by the parts nearest to each unit's buildings.

    Parts of another unit than the parcel's have ban 0.
    """
    key = F.concat_ws("|", "legal", "lot")
    named = parcels.withColumn("_k", key)
    sites = buildings.select(key.alias("_k"), F.col("tong").alias("label"), "x", "y")
    hit = named.join(sites.select("_k").distinct(), "_k", "left_semi")
    parts = voronoi_split(hit.select("_k", "geom"), sites.join(hit.select("_k").distinct(), "_k", "left_semi"), "_k", 0.0)
    proto = hit.groupBy("_k").agg(F.min_by(F.struct("legal", "lot", "tong", "ban"), F.struct("tong", "ban")).alias("p"))
    new = parts.join(proto, "_k").select("p.legal", "p.lot", F.col("label").alias("tong"), F.when(F.col("label") == F.col("p.tong"), F.col("p.ban")).otherwise(0).alias("ban"), "geom")
    return named.join(sites.select("_k").distinct(), "_k", "left_anti").select("legal", "lot", "tong", "ban", "geom").unionByName(new)


def unit_layer(parcels: DataFrame, key: str) -> DataFrame:
    """(key, geom, area, x, y): each unit's boundary from its tiling parcels, with a point inside for its label."""

    def run(table: pa.Table) -> pa.Table:
        parts = [p for g in _rings(table) for p in g]
        rings = shapes.dissolve([p[0] for p in parts], holes=[h for p in parts for h in p[1:]])
        outer = sorted((r for r in rings if shapes.ring_area(r) > 0), key=shapes.ring_area, reverse=True)
        polygons = [[r] for r in outer]
        for hole in (r for r in rings if shapes.ring_area(r) < 0):
            home = [p for p in polygons if shapes.contains([p[0]], hole[:1] + 1e-9)[0]]
            (home[-1] if home else polygons[0]).append(hole)
        x, y = shapes.inner_point(polygons[0])
        geom = shapes.to_wkb(polygons[0]) if len(polygons) == 1 else shapes.to_multi(polygons)
        return pa.table({key: table.column(key).slice(0, 1), "geom": pa.array([geom], pa.binary()), "area": pa.array([sum(map(shapes.area, polygons))], pa.float64()), "x": pa.array([x], pa.float64()), "y": pa.array([y], pa.float64())})

    return parcels.groupBy(key).applyInArrow(run, f"`{key}` {dict(parcels.dtypes)[key]}, geom binary, area double, x double, y double")


def map_geometry(df: DataFrame, kernel, geom: str = "geom") -> DataFrame:
    """df with its polygons through a kernel (polygons -> polygons): clean, simplify, project. Empty results are null."""
    at = df.columns.index(geom)

    def run(batches):
        for b in batches:
            out = []
            for g in b.column(at).to_pylist():
                p = kernel(shapes.from_wkb(g)) if g is not None else []
                out.append(None if not p else shapes.to_wkb(p[0]) if len(p) == 1 else shapes.to_multi(p))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def clean_units(df: DataFrame, least_part: float = 500.0, largest_hole: float = 3000.0) -> DataFrame:
    return map_geometry(df, lambda p: shapes.clean(p, least_part, largest_hole))


def simplify_units(df: DataFrame, tolerance: float = 8.0) -> DataFrame:
    return map_geometry(df, lambda p: [[shapes.simplify_ring(r, tolerance) for r in rings] for rings in p])


def project_units(df: DataFrame, to_degrees: bool = True) -> DataFrame:
    f = projection.to_degrees if to_degrees else projection.to_metres
    return map_geometry(df, lambda p: [[np.stack(f(r[:, 0], r[:, 1]), 1) for r in rings] for rings in p])


def reproject(df: DataFrame, to: str, crs: str = "crs", geom: str = "geom") -> DataFrame:
    """df with its polygons in `to`, each from the system its row names (an EPSG code or the text of a .prj file)."""
    at, named = df.columns.index(geom), df.columns.index(crs)

    def run(batches):
        for b in batches:
            out = []
            for g, source in zip(b.column(at).to_pylist(), b.column(named).to_pylist(), strict=True):
                p = [[projection.move(r, source, to) for r in rings] for rings in shapes.from_wkb(g)] if g is not None else []
                out.append(None if not p else shapes.to_wkb(p[0]) if len(p) == 1 else shapes.to_multi(p))
            new = {at: pa.array(out, pa.binary()), named: pa.array([to] * len(b), pa.string())}
            yield pa.RecordBatch.from_arrays([new.get(k, c) for k, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)
