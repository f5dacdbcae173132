"""Layers of districts: general overlays by key, unions of any size, road filling, unassigned land, overview and reproduction checks.

Geometry is joined by a grid or by key before a kernel sees it. Unions go by cell first, so that a task holds one cell's shapes
and what is left of them: with each further level, cells grow and boundaries inside them are gone.
"""

from __future__ import annotations

import colorsys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.geometry import overlay, shapes
from lotweave.operators.spatial import cell, held, map_geometry, points_in_polygons, split_roads
from lotweave.operators.tables import written

SIDES = ["minx", "miny", "maxx", "maxy"]


def _packed(polygons) -> bytes | None:
    return None if not polygons else shapes.to_wkb(polygons[0]) if len(polygons) == 1 else shapes.to_multi(polygons)


def _shapes(column) -> list:
    return [p for g in column.to_pylist() if g is not None for p in shapes.from_wkb(g)]


def with_numbers(df: DataFrame, names: list[str], numbers, geom: str = "geom") -> DataFrame:
    """df with columns that numbers(polygons) gives for each row's polygons; null without any."""

    def run(batches):
        for b in batches:
            got = [numbers(shapes.from_wkb(g)) if g is not None else [None] * len(names) for g in b.column(b.schema.get_field_index(geom)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([r[k] for r in got], pa.float64()) for k in range(len(names))]], names=[*b.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, kinds + "".join(f", {n} double" for n in names))


def with_bounds(df: DataFrame, geom: str = "geom") -> DataFrame:
    return with_numbers(df, SIDES, lambda p: [*map(float, np.vstack([r[0] for r in p]).min(0)), *map(float, np.vstack([r[0] for r in p]).max(0))], geom)


def with_inner_point(df: DataFrame, geom: str = "geom") -> DataFrame:
    """df with x and y of a point inside each row's largest polygon."""
    return with_numbers(df, ["x", "y"], lambda p: [*shapes.inner_point(max(p, key=shapes.area))], geom)


def with_area(df: DataFrame, geom: str = "geom") -> DataFrame:
    return with_numbers(df, ["area"], lambda p: [float(sum(map(shapes.area, p)))], geom)


def _parts(df: DataFrame, geom: str, of) -> DataFrame:
    """A row for each WKB geometry that of(geometry) gives."""
    at = df.columns.index(geom)

    def run(batches):
        for b in batches:
            parts = [of(g) if g is not None else [] for g in b.column(at).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(b)), [len(p) for p in parts]))
            geoms = pa.array([q for p in parts for q in p], pa.binary())
            yield pa.RecordBatch.from_arrays([geoms if k == at else c.take(rows) for k, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def polygon_parts(df: DataFrame, geom: str = "geom") -> DataFrame:
    """A row for each polygon of a row's geometry, collections included; lines and points go, and rows without polygons."""
    return _parts(df, geom, lambda g: [shapes.to_wkb(p) for p in shapes.pieces(g)[0] if p])


def line_parts(df: DataFrame, geom: str = "geom") -> DataFrame:
    """A row for each line of a row's geometry, collections included; polygons and points go, and rows without lines."""
    return _parts(df, geom, lambda g: [shapes.line_to_wkb(x) for x in shapes.pieces(g)[1] if len(x)])


#: Overlays of a key's left and right shapes, by name.
OVERLAYS = {"intersection": lambda a, b: a & b, "difference": lambda a, b: a & ~b, "symmetric": lambda a, b: a ^ b, "union": lambda a, b: a | b}


def overlay_by(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """(key, geom, area): how the united left shapes (key, geom) and right shapes (key, geom) of each key combine; empty ones have a null geom and area 0."""
    return overlays_by(left, right, key, [how]).drop("how")


def overlays_by(left: DataFrame, right: DataFrame, key: str, hows: list[str]) -> DataFrame:
    """(key, how, geom, area): overlay_by in several ways, over edges that are cut once."""
    insides, kind = [OVERLAYS[how] for how in hows], dict(left.dtypes)[key]

    # New names for the right side's columns: it may be made from the same table as the left one.
    right = right.select(F.col(key).alias("_k"), F.col("geom").alias("_g")).select(F.col("_k").alias(key), F.col("_g").alias("geom"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = overlay.overlays(*[_shapes(t.column("geom")) if len(t) else [] for t in (a, b)], insides)
        name = (a if len(a) else b).column(key).take(pa.array([0] * len(hows)))
        return pa.table({key: name, "how": pa.array(hows), "geom": pa.array(map(_packed, found), pa.binary()), "area": pa.array([float(sum(map(shapes.area, f))) for f in found], pa.float64())})

    return left.select(key, "geom").groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, f"`{key}` {kind}, how string, geom binary, area double")


def clip(units: DataFrame, districts: DataFrame, key: str = "code", unit: str = "tong") -> DataFrame:
    """(key, unit, geom): units (key, unit, geom) cut to their district (key, geom, clip); whole where clip is false or there is no district.

    Units whose geometry lies outside go. Each unit is cut by itself, so a large district is no large task.
    """
    d = districts.where("clip").select(key, F.col("geom").alias("_d"))
    met = units.select(key, unit, "geom").join(d, key, "left")

    def run(batches):
        for b in batches:
            out = []
            for g, d in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                out.append(g if d is None or g is None else _packed(overlay.intersection(shapes.from_wkb(g), shapes.from_wkb(d))))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, pa.binary())], names=[key, unit, "geom"])

    kinds = dict(units.dtypes)
    return met.mapInArrow(run, f"`{key}` {kinds[key]}, `{unit}` {kinds[unit]}, geom binary").where("geom is not null")


def _united(df: DataFrame, by: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)

    def run(table: pa.Table) -> pa.Table:
        return pa.table({**{c: table.column(c).slice(0, 1) for c in by}, "geom": pa.array([_packed(overlay.union(_shapes(table.column("geom"))))], pa.binary())})

    return df.select(*by, "geom").groupBy(*by).applyInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", geom binary")


def union_by(df: DataFrame, key: str, size: float) -> DataFrame:
    """(key, geom): the union of each key's polygons, which may overlap; first by cells of `size`, then by key."""
    at = with_bounds(df.select(key, "geom")).where("geom is not null")
    cells = at.select(key, "geom", cell(F.col("minx"), size).alias("_i"), cell(F.col("miny"), size).alias("_j"))
    return _united(_united(cells, [key, "_i", "_j"]).select(key, "geom"), [key])


def union_all(df: DataFrame, size: float, growth: int = 8) -> DataFrame:
    """(geom): the union of all polygons, cell by cell; cells grow until one is left. Empty input gives no row."""
    at = with_bounds(df.select("geom").where("geom is not null"))
    level = written(_united(at.select("geom", cell(F.col("minx"), size).alias("_i"), cell(F.col("miny"), size).alias("_j")), ["_i", "_j"]))
    while level.limit(2).count() > 1:
        # Divided towards zero, so that cells on both sides of the origin meet in the end.
        level = written(_united(level.select("geom", F.expr(f"_i div {growth}").alias("_i"), F.expr(f"_j div {growth}").alias("_j")), ["_i", "_j"]))
    return level.select("geom")


def outline(districts: DataFrame, size: float, gap: float = 40.0, least: float = 50_000.0, tolerance: float = 15.0) -> DataFrame:
    """(geom): the outer rings of all districts together: gaps closed, holes filled, small parts left out (the largest stays if all are small)."""

    def outer(polygons):
        rings = [[p[0]] for p in overlay.closing(polygons, gap)]
        large = [p for p in rings if shapes.area(p) >= least] or sorted(rings, key=shapes.area)[-1:]
        return [[shapes.simplify_ring(p[0], tolerance)] for p in large]

    return map_geometry(union_all(districts, size), outer)


def meeting(left: DataFrame, right: DataFrame, distance: float, size: float, ordered: bool = False) -> DataFrame:
    """Pairs (id, other) of polygons (id, geom) at most `distance` apart, with ordered only those with id < other.

    By cells of their bounds, then by their distance. Rectangles along the axes are their bounds, so that pairs of them need no
    geometry; the others' geometries are read again. size should be about that of the polygons: each is listed in all cells it
    touches, and a pair counts in the first cell that both are in.
    """
    half = distance / 2
    span = lambda lo, hi: F.sequence(F.col(lo), cell(F.col(hi) + half, size))
    sides = lambda p: [*map(float, np.vstack([r[0] for r in p]).min(0)), *map(float, np.vstack([r[0] for r in p]).max(0)), float(len(p) == 1 == len(p[0]) and shapes.is_box(p[0][0]))]

    def cells(df):
        bounds = with_numbers(df.select("id", "geom"), [*SIDES, "box"], sides).drop("geom")
        bounds = bounds.select("*", cell(F.col("minx") - half, size).alias("i0"), cell(F.col("miny") - half, size).alias("j0"))
        return bounds.select("*", F.explode(span("i0", "maxx")).alias("i")).select("*", F.explode(span("j0", "maxy")).alias("j"))

    b = cells(right).select(F.col("id").alias("other"), *[F.col(c).alias(f"o_{c}") for c in (*SIDES, "box", "i0", "j0")], "i", "j")
    dx = F.greatest(F.lit(0.0), F.col("o_minx") - F.col("maxx"), F.col("minx") - F.col("o_maxx"))
    dy = F.greatest(F.lit(0.0), F.col("o_miny") - F.col("maxy"), F.col("miny") - F.col("o_maxy"))
    near = cells(left).join(b, ["i", "j"]).where((F.col("i") == F.greatest("i0", "o_i0")) & (F.col("j") == F.greatest("j0", "o_j0")) & (dx * dx + dy * dy <= distance * distance))
    near = near.where("id < other") if ordered else near
    near = near.select("id", "other", ((F.col("box") == 1) & (F.col("o_box") == 1)).alias("plain"))
    rest = near.where("not plain").join(left.select("id", F.col("geom").alias("_a")), "id").join(right.select(F.col("id").alias("other"), F.col("geom").alias("_b")), "other").select("id", "other", "_a", "_b")

    def run(batches):
        for b in batches:
            good = [overlay.apart(shapes.from_wkb(x), shapes.from_wkb(y)) <= distance for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["id", "other"]).filter(pa.array(good, pa.bool_()))

    kinds = dict(rest.dtypes)
    return near.where("plain").select("id", "other").unionByName(rest.mapInArrow(run, f"id {kinds['id']}, other {kinds['other']}"))


def neighbours(units: DataFrame, distance: float, size: float) -> DataFrame:
    """Pairs (id, other), id < other, of units at most `distance` apart."""
    return meeting(units, units, distance, size, ordered=True)


def road_fill(parcels: DataFrame, jimok: list[str], size: float, reach: float = 0.5, sliver: float = 5.0) -> DataFrame:
    """(id, tong, fill, area): unassigned road parcels given to the units they touch; see split_roads for the ways.

    parcels: (id, jimok, tong, geom); a road has one of the given kinds of land and no unit. Roads that touch no unit are left out.
    """
    roads = parcels.where(F.col("tong").isNull() & F.col("jimok").isin(jimok)).select("id", "geom")
    units = parcels.where("tong is not null").select("id", "tong", "geom")
    pairs = meeting(roads, units.select("id", "geom"), reach, size)
    beside = pairs.join(units.select(F.col("id").alias("other"), "tong", "geom"), "other").select("id", "tong", "geom")
    return split_roads(roads, beside, least=sliver)


def nearest_shape(points: DataFrame, polygons: DataFrame, start: float) -> DataFrame:
    """(id, other, d): the polygon (box, minx, miny, maxx, maxy, geom) nearest to each point (id, x, y), the least id on ties; 0 inside.

    The search distance doubles for the points that have found none; polygons are listed in the cells of their bounds.
    """
    left, out, distance = points.select("id", "x", "y").where("x is not null and y is not null"), None, start
    if not polygons.limit(1).count():
        return left.select("id", F.lit(None).cast(dict(polygons.dtypes)["box"]).alias("other"), F.lit(None).cast("double").alias("d")).limit(0)
    while True:
        span = lambda lo, hi, d=distance: F.sequence(cell(F.col(lo) - d, d), cell(F.col(hi) + d, d))
        boxes = polygons.drop("geom").select("*", F.explode(span("minx", "maxx")).alias("i")).select("*", F.explode(span("miny", "maxy")).alias("j"))
        at = left.select("*", cell(F.col("x"), distance).alias("i"), cell(F.col("y"), distance).alias("j"))
        met = at.join(boxes, ["i", "j"]).select("id", "x", "y", "box").join(polygons.select("box", "geom"), "box").select("id", "box", "x", "y", "geom")

        def run(batches, distance=distance):
            for b in batches:
                d = []
                for x, y, g in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                    d.append(from_point(np.array([x, y]), shapes.from_wkb(g)))
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(d, pa.float64())], names=["id", "other", "d"]).filter(pa.array([v <= distance for v in d], pa.bool_()))

        kinds = dict(met.dtypes)
        pairs = met.mapInArrow(run, f"id {kinds['id']}, other {kinds['box']}, d double")
        best = written(pairs.groupBy("id").agg(F.min(F.struct("d", "other")).alias("b")).select("id", "b.other", "b.d"))
        out = best if out is None else out.unionByName(best)
        left = written(left.join(best.select("id"), "id", "left_anti"))
        if not left.limit(1).count():
            return out
        distance *= 2


def from_point(p: np.ndarray, polygons: list) -> float:
    """The distance of a point to polygons; 0 inside."""
    if overlay.covered(polygons, p[None])[0]:
        return 0.0
    e = overlay.edges_of(polygons, 12)
    a, d = e[:, :2], e[:, 2:] - e[:, :2]
    s = np.clip(((p - a) * d).sum(1) / (d * d).sum(1), 0, 1)
    return float(np.hypot(*(a + s[:, None] * d - p).T).min())


def first_polygon(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """points with the least polygon that holds them, or none."""
    hit = points_in_polygons(points.select("id", "x", "y"), polygons, size).groupBy("id").agg(F.min("box").alias("box"))
    return points.join(hit, "id", "left")


def unassigned_layer(parcels: DataFrame, districts: DataFrame, size: float, land: str = "대") -> DataFrame:
    """parcels (id, code, legal, lot, jimok, tong, geom) without a unit, of a kind of land, with a point inside that lies in their district (code, geom).

    A parcel meets its own district only.
    """
    free = parcels.where(F.col("tong").isNull() & F.col("jimok").startswith(land))
    at = with_inner_point(free.select("id", "code", "geom")).select("id", "code", "x", "y")
    own = held(at.where("x is not null").join(districts.where("geom is not null").select("code", "geom"), "code").withColumnRenamed("code", "box")).select("id")
    return free.join(own, "id", "left_semi").select("id", "code", "legal", "lot", "jimok", "geom")


def overview(units: DataFrame, districts: DataFrame, unit_tolerance: float = 8.0, district_tolerance: float = 15.0) -> DataFrame:
    """(layer, code, dong, tong, geom): all units (code, dong, tong, geom) and districts (code, dong, geom), simplified."""
    simple = lambda df, t: map_geometry(df, lambda p: [[shapes.simplify_ring(r, t) for r in rings] for rings in p])
    a = simple(units.select(F.lit("tong").alias("layer"), "code", "dong", "tong", "geom"), unit_tolerance)
    return a.unionByName(simple(districts.select(F.lit("admin").alias("layer"), "code", "dong", F.lit(None).cast(dict(units.dtypes)["tong"]).alias("tong"), "geom"), district_tolerance))


def reproduction(new: DataFrame, golden: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """(key, side, relative, ok): each unit's symmetric difference against the golden area; units of one side only aren't ok."""
    sides = new.select(key).distinct().withColumn("_n", F.lit(1)).join(golden.select(key).distinct().withColumn("_g", F.lit(1)), key, "full")
    off = overlay_by(new, golden, key, "symmetric").select(key, F.col("area").alias("_off"))
    whole = with_area(_united(golden.select(key, "geom"), [key])).groupBy(key).agg(F.sum("area").alias("_all"))
    side = F.when(F.col("_g").isNull(), "new").when(F.col("_n").isNull(), "golden").otherwise("both")
    relative = F.when(side == "both", F.col("_off") / F.greatest(F.col("_all"), F.lit(1e-9)))
    out = sides.join(off, key, "left").join(whole, key, "left").select(key, side.alias("side"), relative.alias("relative"))
    return out.withColumn("ok", F.coalesce(F.col("relative") <= tolerance, F.lit(False)))


def issues(table: DataFrame, drawn: DataFrame, reasons: DataFrame, places: list[DataFrame], centres: DataFrame, conflicts: DataFrame, unassigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(districts, missing): counts by district, and its units that the map lacks with their kind, reason and place.

    table: (code, tong, apt); drawn: (code, tong); reasons: (code, tong, kind, reason); places: (code, tong, x, y) tables, the first
    that knows a unit counts; centres: (code, x, y) for the others, whose place is then approximate; conflicts and unassigned: (code).
    """
    key = ["code", "tong"]
    units = table.groupBy(*key).agg(F.max("apt").alias("apt"))
    lost = units.join(drawn.select(*key).distinct(), key, "left_anti").join(reasons, key, "left")
    merged = F.coalesce(F.col("reason").rlike("충돌|흡수"), F.lit(False))
    kind = F.when(F.col("apt"), "아파트").otherwise(F.coalesce("kind", F.lit("")))
    why = F.when(F.col("apt"), "아파트 동별 분할 — 아파트명+동 검색").when(merged, "인접 통에 포함됨").otherwise("지번 확인 필요")
    missing = lost.select(*key, kind.alias("kind"), why.alias("reason"))
    for k, p in enumerate(places):
        one = p.groupBy(*key).agg(F.min(F.struct("x", "y")).alias(f"_{k}"))
        missing = missing.join(one, key, "left")
    known = F.coalesce(*[F.col(f"_{k}") for k in range(len(places))]) if places else F.lit(None).cast("struct<x:double,y:double>")
    missing = missing.join(centres.select("code", F.struct("x", "y").alias("_c")), "code", "left").withColumn("_p", F.coalesce(known, F.col("_c")))
    missing = missing.select(*key, "kind", "reason", "_p.x", "_p.y", (known.isNull() & F.col("_c").isNotNull()).alias("approx"))
    count = lambda df, name: df.groupBy("code").agg(F.count("*").alias(name))
    out = count(units, "n_table")
    for name, df in (("n_drawn", drawn.select(*key).distinct()), ("n_missing", missing), ("n_conflict", conflicts), ("n_unassigned", unassigned)):
        out = out.join(count(df, name), "code", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return out, missing


# Lightness and saturation of the palettes; the grey one goes by lightness only.
PALETTES = {"default": (0.55, 0.65), "pastel": (0.78, 0.48), "vivid": (0.48, 0.85), "gray": None}


def slot_color(slot: Column, palette: str = "default", override: Column | None = None, slots: int = 12) -> Column:
    """A slot's colour as #rrggbb: an even step of the colour wheel, unless a unit has a colour of its own."""
    tone = PALETTES.get(palette, PALETTES["default"])

    def color(k: int) -> str:
        rgb = colorsys.hls_to_rgb(k / slots, *tone) if tone else ((35 + k * 53 % 50) / 100,) * 3
        return "#" + "".join(f"{round(255 * v):02x}" for v in rgb)

    found = F.get(F.array(*[F.lit(color(k)) for k in range(slots)]), F.pmod(slot, F.lit(slots)).cast("int"))
    return found if override is None else F.coalesce(F.nullif(override, F.lit("")), found)
