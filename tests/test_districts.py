import struct

import numpy as np
import pytest

from lotweave.geometry import shapes
from lotweave.operators import districts as D


def square(x, y, s):
    return np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)


def test_outline_closes_gaps_fills_holes_and_drops_small_parts(spark):
    ring = [square(0, 0, 1000), square(400, 400, 200)[::-1]]
    parts = [[ring], [[square(1030, 0, 1000)]], [[square(5000, 5000, 100)]]]
    df = spark.createDataFrame([(shapes.to_multi(p),) for p in parts], "geom binary")
    (row,) = D.outline(df, 500.0).collect()
    polygons = shapes.from_wkb(row.geom)
    assert len(polygons) == 1 and len(polygons[0]) == 1
    assert abs(shapes.area(polygons[0]) - 2_030_000) < 3_000
    (small,) = D.outline(df.where(D.F.length("geom") < 120), 500.0).collect()
    assert len(shapes.from_wkb(small.geom)) == 1


def test_unions_and_parts_of_odd_rows(spark):
    empty = spark.createDataFrame([], "k int, geom binary")
    assert D.union_all(empty, 10.0).count() == 0 and D.union_by(empty, "k", 10.0).count() == 0 and D.polygon_parts(empty).count() == 0
    df = spark.createDataFrame([(1, shapes.to_multi([[square(0, 0, 1)], [square(5, 5, 2)]])), (1, shapes.to_wkb([square(0.5, 0, 1)])), (2, None)], "k int, geom binary")
    assert [(r.k, round(r.area, 6)) for r in D.with_area(D.union_by(df, "k", 2.0)).collect()] == [(1, 5.5)]
    assert sorted(round(r.area, 6) for r in D.with_area(D.polygon_parts(df)).collect()) == [1, 1, 4]
    assert [(r.x is None) for r in D.with_inner_point(df).orderBy("k").collect()][-1]


def test_cells_on_both_sides_of_the_origin_unite(spark):
    rng = np.random.default_rng(2)
    rows = [(shapes.to_wkb([square(float(x), float(y), 7)]),) for x, y in rng.integers(-200, 200, (60, 2))]
    (row,) = D.union_all(spark.createDataFrame(rows, "geom binary"), 16.0, 2).collect()
    cells = {(i, j) for (g,) in rows for x, y in [shapes.from_wkb(g)[0][0][0].astype(int)] for i in range(x, x + 7) for j in range(y, y + 7)}
    assert abs(sum(map(shapes.area, shapes.from_wkb(row.geom))) - len(cells)) < 1e-6


def test_overlays_of_keys_on_one_side_only(spark):
    a = spark.createDataFrame([(1, shapes.to_wkb([square(0, 0, 2)]))], "k int, geom binary")
    b = spark.createDataFrame([(2, shapes.to_wkb([square(0, 0, 3)]))], "k int, geom binary")
    got = {how: {r.k: r.area for r in D.overlay_by(a, b, "k", how).collect()} for how in D.OVERLAYS}
    assert got == {"intersection": {1: 0, 2: 0}, "difference": {1: 4, 2: 0}, "symmetric": {1: 4, 2: 9}, "union": {1: 4, 2: 9}}


def test_palettes(spark):
    r = spark.range(1).select(D.slot_color(D.F.lit(0), "gray").alias("a"), D.slot_color(D.F.lit(12), "vivid").alias("b"), D.slot_color(D.F.lit(0), "unknown", D.F.lit("")).alias("c")).first()
    assert (r.a, r.c) == ("#595959", "#d74242") and r.b.startswith("#e2")


def test_parts_of_collections(spark):
    line = np.array([[0.0, 0], [1, 1], [2, 0]])
    point = struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    lines = struct.pack("<BII", 1, 5, 2) + shapes.line_to_wkb(line) + shapes.line_to_wkb(line + 5)
    mixed = struct.pack("<BII", 1, 7, 3) + shapes.to_multi([[square(0, 0, 1)], [square(5, 5, 2)]]) + lines + point
    nested = struct.pack("<BII", 1, 7, 1) + mixed
    df = spark.createDataFrame([(1, nested), (2, point), (3, None), (4, shapes.to_wkb([square(0, 0, 3)])), (5, struct.pack("<BII", 1, 7, 0))], "k int, geom binary")
    assert sorted((r.k, r.area) for r in D.with_area(D.polygon_parts(df)).collect()) == [(1, 1.0), (1, 4.0), (4, 9.0)]
    got = D.line_parts(df).collect()
    assert sorted((r.k, float(shapes.pieces(bytes(r.geom))[1][0][0, 0])) for r in got) == [(1, 0.0), (1, 5.0)]
    with pytest.raises(ValueError):
        shapes.from_wkb(nested)


def test_unassigned_parcels_centred_on_the_district_line_are_left_out(spark):
    rows = [(k, 1 + k // 4, "가람동", str(k), "대", None, shapes.to_wkb([square(x, 4, 2)])) for k, x in enumerate([-1, 9, 4, 20, 4])]
    parcels = spark.createDataFrame(rows, "id int, code int, legal string, lot string, jimok string, tong int, geom binary")
    districts = spark.createDataFrame([(1, shapes.to_wkb([square(0, 0, 10)])), (2, shapes.to_wkb([square(50, 0, 10)]))], "code int, geom binary")
    assert [r.id for r in D.unassigned_layer(parcels, districts, 5.0).collect()] == [2]


def test_rectangles_meet_by_their_bounds_and_others_by_their_edges(spark):
    ell = np.array([[20, 0], [30, 0], [30, 2], [22, 2], [22, 10], [20, 10]], float)
    rows = [(1, [square(0, 0, 10)]), (2, [square(13, 4, 3)]), (3, [ell]), (4, [square(25, 6, 3)]), (5, [square(0, 0, 10), square(2, 2, 5)[::-1]]), (6, [square(4, 4, 1)])]
    units = spark.createDataFrame([(k, shapes.to_wkb(p)) for k, p in rows], "id int, geom binary")
    want = [(a, b) for a, p in rows for b, q in rows if a < b and D.overlay.apart([p], [q]) <= 3]
    for size in (2.0, 7.0, 100.0):
        assert sorted((r.id, r.other) for r in D.neighbours(units, 3.0, size).collect()) == want
    plan = D.neighbours(units.where("id in (1, 2, 4, 6)"), 3.0, 7.0)
    assert sorted((r.id, r.other) for r in plan.collect()) == [(1, 2), (1, 6)]
