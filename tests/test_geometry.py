import time

import numpy as np
import pytest

from lotweave.geometry import projection, shapes
from lotweave.operators import spatial as S

SQUARE = np.array([[0.0, 0], [10, 0], [10, 10], [0, 10]])
L_SHAPE = np.array([[0.0, 0], [10, 0], [10, 4], [4, 4], [4, 10], [0, 10]])


def jts(spark):
    jvm = spark._jvm
    return jvm.org.locationtech.jts.io.WKBReader(), jvm


def read(spark, polygon):
    reader, _ = jts(spark)
    return reader.read(bytearray(shapes.to_wkb(polygon)))


def test_measures_equal_jts(spark):
    hole = np.array([[1.0, 1], [2, 1], [2, 2], [1, 2]])
    for polygon in ([SQUARE], [L_SHAPE], [SQUARE, hole]):
        g = read(spark, polygon)
        assert abs(shapes.area(polygon) - g.getArea()) < 1e-9
        assert abs(sum(map(shapes.length, polygon)) - g.getLength()) < 1e-9
    c = read(spark, [L_SHAPE]).getCentroid()
    assert np.allclose(shapes.centroid(L_SHAPE), (c.getX(), c.getY()))
    for polygon in ([L_SHAPE], [SQUARE, np.array([[1.0, 1], [9, 1], [9, 9], [1, 9]])]):
        x, y = shapes.inner_point(polygon)
        assert shapes.contains(polygon, np.array([[x, y]]))[0]


def test_contains_equals_jts(spark):
    rng = np.random.default_rng(1)
    g = read(spark, [L_SHAPE])
    factory = spark._jvm.org.locationtech.jts.geom.GeometryFactory()
    at = rng.uniform(-1, 11, (60, 2))
    want = [g.contains(factory.createPoint(spark._jvm.org.locationtech.jts.geom.Coordinate(float(x), float(y)))) for x, y in at]
    assert shapes.contains([L_SHAPE], at).tolist() == want


def test_points_on_an_edge_are_not_inside(spark):
    at = [(k, float(x), float(y)) for k, (x, y) in enumerate([(0, 5), (5, 0), (10, 2), (4, 7), (7, 4), (4, 4), (0, 0), (2, 2), (3.5, 9.5)])]
    points = spark.createDataFrame(at, "id long, x double, y double")
    polygons = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, shapes.to_wkb([L_SHAPE]))], "box long, minx double, miny double, maxx double, maxy double, geom binary")
    assert sorted(r.id for r in S.points_in_polygons(points, polygons, 3.0).collect()) == [7, 8]


def test_voronoi_tiles_its_parent_and_equals_jts(spark):
    rng = np.random.default_rng(2)
    sites = rng.uniform(0, 10, (7, 2))
    cells = shapes.voronoi(SQUARE, sites)
    assert abs(sum(abs(shapes.ring_area(c)) for c in cells) - 100) < 1e-9
    at = rng.uniform(0, 10, (300, 2))
    nearest = ((at[:, None] - sites[None]) ** 2).sum(2).argmin(1)
    for k, c in enumerate(cells):
        assert (shapes.contains([c], at) == (nearest == k)).all()
    jvm = spark._jvm
    points = jvm.java.util.ArrayList()
    for x, y in sites:
        points.add(jvm.org.locationtech.jts.geom.Coordinate(float(x), float(y)))
    b = jvm.org.locationtech.jts.triangulate.VoronoiDiagramBuilder()
    b.setSites(points)
    b.setClipEnvelope(jvm.org.locationtech.jts.geom.Envelope(-50.0, 60.0, -50.0, 60.0))
    found = b.getDiagram(jvm.org.locationtech.jts.geom.GeometryFactory())
    box = read(spark, [SQUARE])
    areas = sorted(found.getGeometryN(i).intersection(box).getArea() for i in range(found.getNumGeometries()))
    assert np.allclose(areas, sorted(abs(shapes.ring_area(c)) for c in cells), atol=1e-6)
    same = shapes.voronoi(SQUARE, np.array([[1.0, 1], [1, 1], [9, 9]]))
    assert len(same[1]) == 0 and abs(abs(shapes.ring_area(same[0])) - 50) < 1e-9


def test_many_sites_tile_their_parent():
    rng = np.random.default_rng(3)
    sites = np.concatenate([rng.normal(3, 2, (3000, 2)), rng.integers(-5, 15, (1000, 2))])
    start = time.perf_counter()
    for ring, whole in ((SQUARE, 100), (L_SHAPE, 64)):
        cells = shapes.voronoi(ring, sites)
        assert abs(sum(abs(shapes.ring_area(c)) for c in cells if len(c)) - whole) < 1e-6
    assert time.perf_counter() - start < 60  # pairs of all sites took minutes
    at = rng.uniform(0, 4, (200, 2))
    nearest = ((at[:, None] - sites[None]) ** 2).sum(2).argmin(1)
    assert all(shapes.contains([cells[k]], p[None])[0] for k, p in zip(nearest, at, strict=True))


def test_roads_are_cut_by_the_places_along_their_neighbours(spark):
    box = lambda x, y, w, h: np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)
    cut = [(1, box(0, 0, 10, 4)), (2, L_SHAPE), (3, box(100, 0, 5, 5)), (4, box(50, 0, 5, 5))]
    roads = spark.createDataFrame([(k, shapes.to_wkb([r])) for k, r in cut], "id long, geom binary")
    beside = [(1, 7, box(-5, 0, 5, 4)), (1, 3, box(10, 0, 5, 4)), (2, 1, box(0, -5, 10, 5)), (2, 2, box(4, 4, 6, 6)), (3, 9, box(105, 0, 1, 1))]
    got = {(r.id, r.tong): (r.fill, r.area) for r in S.split_roads(roads, spark.createDataFrame([(k, t, shapes.to_wkb([r])) for k, t, r in beside], "id long, tong int, geom binary"), least=0.0).collect()}
    for k, ring in cut[:2]:
        mine = [(t, shapes.along(r, np.arange(12) / 12)) for i, t, r in beside if i == k]
        at, label = np.concatenate([p for _, p in mine]), np.repeat([t for t, _ in mine], 12)
        fine = np.stack(np.meshgrid(np.arange(0.01, 10, 0.02), np.arange(0.01, 10, 0.02)), -1).reshape(-1, 2)
        fine = fine[shapes.contains([ring], fine)]
        near = label[((fine[:, None] - at[None]) ** 2).sum(2).argmin(1)]
        for t, _ in mine:
            assert got[k, t][0] == "road_split" and abs(got[k, t][1] - (near == t).sum() * 0.0004) < 0.2
    assert got[3, 9] == ("road_match", 25) and len(got) == 5


def test_dissolve_faces_simplify_clean():
    tiles = [SQUARE + [10 * i, 10 * j] for i, j in ((0, 0), (1, 0), (0, 1))] + [SQUARE + [100, 0]]
    rings = shapes.dissolve(tiles)
    assert sorted(round(shapes.ring_area(r)) for r in rings) == [100, 300]
    ring = shapes.dissolve([SQUARE + [10 * i, 10 * j] for i in range(3) for j in range(3) if (i, j) != (1, 1)])
    assert sorted(round(shapes.ring_area(r)) for r in ring) == [-100, 900]
    lines = np.array([[k, -1, k, 4] for k in range(4)] + [[-1, k, 4, k] for k in range(4)], float)
    assert [shapes.ring_area(f) for f in shapes.faces(lines, least=0.5)] == [1.0] * 9
    wave = np.stack([np.arange(50.0), np.sin(np.arange(50.0)) * 0.4], 1)
    assert len(shapes.simplify(wave, 0.9)) == 2 and len(shapes.simplify(wave, 0.0001)) == 50
    hole = np.array([[1.0, 1], [2, 1], [2, 2], [1, 2]])
    assert len(shapes.clean([[SQUARE, hole], [hole]], 50, 3)) == 1 and len(shapes.clean([[SQUARE, hole]], 50, 3)[0]) == 1
    assert len(shapes.clean([[hole]], 50, 3)) == 1
    assert abs(shapes.ring_area(shapes.clip_convex(L_SHAPE, SQUARE[::-1] * 0.5)) - 24) < 1e-9
    pieces = shapes.clip_line(np.array([-5.0, 7]), np.array([15.0, 7]), [L_SHAPE])
    assert len(pieces) == 1 and np.allclose(pieces[0], [[0, 7], [4, 7]])
    assert [len(p) for p in shapes.from_wkb(shapes.to_wkb([SQUARE, hole]))] == [2]


def test_projection_round_trip():
    lon, lat = np.array([126.7, 127.0, 128.9]), np.array([37.3, 38.0, 34.1])
    x, y = projection.to_metres(lon, lat)
    assert np.allclose([x[1], y[1]], [200000, 600000], atol=1e-6)
    back = projection.to_degrees(x, y)
    assert np.allclose(back, [lon, lat], atol=1e-9)
    # One degree of longitude at this latitude, from the ellipsoid's radius there.
    e2 = projection.FLATTENING * (2 - projection.FLATTENING)
    radius = projection.SEMI_MAJOR / np.sqrt(1 - e2 * np.sin(np.radians(38)) ** 2) * np.cos(np.radians(38))
    east = projection.to_metres(127.001, 38.0)[0] - 200000
    assert abs(east - radius * np.radians(0.001)) < 1e-3


def test_coloring_keeps_neighbours_apart(spark):
    from lotweave.plans import space_queries as Q

    sf = "/root/testdata/sf0.001"
    got = {(r.district, r.id): r.slot for r in Q.coloring(spark, sf).collect()}
    b = Q.boxes(spark, sf)
    pairs = [(r.box, r.other) for r in S.box_pairs(b, 12.0, 16.0).collect() if r.box % 25 == r.other % 25]
    assert len(got) == b.count()
    assert all(got[a % 25, a] != got[c % 25, c] for a, c in pairs)


def test_roads_go_to_the_units_beside_them(spark):
    box = lambda x1, y1, x2, y2: bytearray(shapes.to_wkb([np.array([[x1, y1], [x2, y1], [x2, y2], [x1, y2]], float)]))
    roads = spark.createDataFrame([(1, box(0, 0, 40, 4)), (2, box(0, 90, 9, 99)), (3, box(0, 50, 40, 54)), (4, box(0, 70, 1, 71))], "id long, geom binary")
    sides = [(1, 5, box(0, 4, 40, 24)), (1, 7, box(0, -20, 40, 0)), (3, 9, box(0, 54, 40, 64)), (4, 6, box(0, 71, 1, 80)), (4, 2, box(0, 60, 1, 70))]
    got = sorted((r.id, r.tong, r.fill, round(r.area, 3)) for r in S.split_roads(roads, spark.createDataFrame(sides, "id long, tong int, geom binary")).collect())
    assert [g[:3] for g in got] == [(1, 5, "road_split"), (1, 7, "road_split"), (3, 9, "road_match"), (4, 2, "manual_pending")]
    assert abs(got[0][3] + got[1][3] - 160) < 1e-6


@pytest.mark.parametrize("name", ["within_distance", "nearest", "components"])
def test_spatial_operators_take_empty_tables(spark, name):
    none = spark.createDataFrame([], "id long, x double, y double")
    some = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], none.schema)
    if name == "components":
        edges = spark.createDataFrame([], "id long, other long")
        assert sorted(map(tuple, S.components(some, edges).collect())) == [(1, 1), (2, 2)]
        return
    f = getattr(S, name)
    assert f(none, some, 5.0).count() == 0 and f(some, none, 5.0).count() == 0


def wkb(*box):
    x1, y1, x2, y2 = box
    return bytearray(shapes.to_wkb([np.array([[x1, y1], [x2, y1], [x2, y2], [x1, y2]], float)]))


def test_blocks_buildings_and_carving(spark):
    blocks = spark.createDataFrame([(k, 100.0, 10.0 * k, 0.0, 10.0 * k + 10, 10.0, wkb(10 * k, 0, 10 * k + 10, 10)) for k in range(4)], "block int, area double, minx double, miny double, maxx double, maxy double, geom binary")
    parcels = [(1, 2.0, 5.0, 7, 20.0), (2, 4.0, 5.0, 7, 20.0), (3, 12.0, 5.0, 7, 20.0), (4, 18.0, 5.0, 8, 20.0), (5, 22.0, 5.0, 9, 90.0), (6, 32.0, 5.0, 9, 1.0), (7, 33.0, 5.0, 9, 1.0)]
    got = sorted(map(tuple, S.assign_blocks(blocks, spark.createDataFrame(parcels, "id int, x double, y double, tong int, area double"), 10.0).collect()))
    assert got == [(0, 7, "single", 100.0), (1, 7, "mixed", 50.0), (1, 8, "mixed", 50.0)]
    lots = spark.createDataFrame([("a", "1", 3, 2, wkb(0, 0, 10, 10)), ("a", "2", 3, 2, wkb(10, 0, 20, 10))], "legal string, lot string, tong int, ban int, geom binary")
    at = spark.createDataFrame([("a", "1", 2.0, 5.0, 3), ("a", "1", 8.0, 5.0, 4), ("b", "9", 8.0, 5.0, 4)], "legal string, lot string, x double, y double, tong int")
    parts = sorted((r.lot, r.tong, r.ban, round(sum(map(shapes.area, shapes.from_wkb(bytes(r.geom)))), 6)) for r in S.split_parcels(lots, at).collect())
    assert parts == [("1", 3, 2, 50.0), ("1", 4, 0, 50.0), ("2", 3, 2, 100.0)]
    units = spark.createDataFrame([(1, wkb(0, 0, 10, 10)), (2, wkb(20, 0, 30, 10))], "tong int, geom binary")
    holes = spark.createDataFrame([(1, wkb(2, 2, 4, 20))], "tong int, geom binary")
    left = S.carve(units, "tong", holes).collect()
    area = {t: round(sum(shapes.area(p) for r in left if r.tong == t for p in shapes.from_wkb(bytes(r.geom))), 6) for t in (1, 2)}
    assert area == {1: 84.0, 2: 100.0}


def test_unit_layer_and_mapped_geometry(spark):
    tiles = [(1, wkb(10 * i, 10 * j, 10 * i + 10, 10 * j + 10)) for i in range(3) for j in range(3) if (i, j) != (1, 1)] + [(2, wkb(100, 0, 110, 10)), (2, wkb(200, 0, 230, 10))]
    layer = S.unit_layer(spark.createDataFrame(tiles, "tong int, geom binary"), "tong")
    got = {r.tong: r for r in layer.collect()}
    assert got[1].area == 800 and [len(p) for p in shapes.from_wkb(bytes(got[1].geom))] == [2]
    assert got[2].area == 400 and len(shapes.from_wkb(bytes(got[2].geom))) == 2
    for r in got.values():
        assert any(shapes.contains(p, np.array([[r.x, r.y]]))[0] for p in shapes.from_wkb(bytes(r.geom)))
    filled = {r.tong: shapes.from_wkb(bytes(r.geom)) for r in S.clean_units(layer, 150, 3000).collect()}
    assert len(filled[1][0]) == 1 and len(filled[2]) == 1
    simple = {r.tong: shapes.from_wkb(bytes(r.geom)) for r in S.simplify_units(layer, 1.0).collect()}
    assert len(simple[1][0][0]) == 4 and abs(shapes.area(simple[1][0]) - 800) < 1e-9
    there = S.project_units(S.project_units(layer), to_degrees=False).where("tong = 2").first()
    assert abs(sum(map(shapes.area, shapes.from_wkb(bytes(there.geom)))) - 400) < 1e-3


def test_parts_are_united_by_label(spark):
    # Each part of unit 8 is under 5, and only together they are more; unit 9 stays under 5.
    at = [(1, 7, 1.0, 7.5), (1, 7, 4.0, 7.5), (1, 7, 9.0, 7.5)] + [(1, 8, 0.25 + k / 2, 2.5) for k in range(20)] + [(1, 9, 9.9, 0.01), (2, 3, 5.0, 5.0), (2, 4, -20.0, 5.0), (3, 5, 0.0, 0.0), (3, 2, 0.0, 0.0), (4, 1, 2.0, 2.0)]
    sites = spark.createDataFrame(at, "k long, label int, x double, y double")
    hole = np.array([[2.0, 2], [8, 2], [8, 8], [2, 8]])
    land = [(1, wkb(0, 0, 10, 10)), (2, bytearray(shapes.to_wkb([SQUARE, hole]))), (3, wkb(0, 0, 5, 10)), (3, wkb(5, 0, 10, 10)), (3, wkb(4, 0, 6, 10)), (5, wkb(0, 0, 1, 1))]
    found = S.voronoi_split(spark.createDataFrame(land, "k long, geom binary"), sites, "k", 5.0).collect()
    got = {(r.k, r.label): (round(r.area, 9), shapes.from_wkb(bytes(r.geom))) for r in found}
    assert len(got) == len(found) and sorted(got) == [(1, 7), (1, 8), (2, 3), (3, 2)]
    assert 95 < got[1, 7][0] + got[1, 8][0] < 100 and len(got[1, 7][1]) == len(got[1, 8][1]) == 1
    assert got[2, 3][0] == 64 and [len(p) for p in got[2, 3][1]] == [2]
    assert got[3, 2][0] == 100 and len(got[3, 2][1]) == 1  # least label of two at one place, rows of a key united
    for area, polygons in got.values():
        assert abs(sum(map(shapes.area, polygons)) - area) < 1e-6


def test_united_parts_are_those_nearest_to_a_labels_sites(spark):
    rng = np.random.default_rng(8)
    land = {1: [SQUARE], 2: [L_SHAPE], 3: [SQUARE, L_SHAPE * 0.5 + 2]}
    sites = np.concatenate([rng.uniform(0, 10, (300, 2)), rng.integers(0, 10, (40, 2))])
    label = rng.integers(0, 3, len(sites))
    parcels = spark.createDataFrame([(k, bytearray(shapes.to_wkb(p))) for k, p in land.items()], "k long, geom binary")
    rows = spark.createDataFrame([(k, int(t), float(x), float(y)) for k in land for t, (x, y) in zip(label, sites, strict=True)], "k long, label int, x double, y double")
    found = S.voronoi_split(parcels, rows, "k", 0.0).collect()
    at = rng.uniform(0, 10, (400, 2))
    order = np.argsort(label, kind="stable")
    near = label[order][((at[:, None] - sites[order][None]) ** 2).sum(2).argmin(1)]
    assert len({(r.k, r.label) for r in found}) == len(found) == 9
    for r in found:
        polygons = shapes.from_wkb(bytes(r.geom))
        held = np.stack([shapes.contains(p, at) for p in polygons]).sum(0)
        assert (held == (shapes.contains(land[r.k], at) & (near == r.label))).all()
        g = jts(spark)[0].read(bytearray(r.geom))
        assert g.isValid() and abs(g.getArea() - r.area) < 1e-6
    for k, p in land.items():
        assert abs(sum(r.area for r in found if r.k == k) - shapes.area(p)) < 1e-9


def test_parts_around_another_units_keep_their_hole_in_a_layer(spark):
    at = [(3 if abs(x - 4.5) > 1 or abs(y - 4.5) > 1 else 4, x + 0.5, y + 0.5) for x in range(10) for y in range(10)]
    buildings = spark.createDataFrame([("a", "1", x, y, t) for t, x, y in at], "legal string, lot string, x double, y double, tong int")
    lots = spark.createDataFrame([("a", "1", 3, 2, wkb(0, 0, 10, 10)), ("a", "2", 3, 2, wkb(10, 0, 20, 10))], "legal string, lot string, tong int, ban int, geom binary")
    parts = S.split_parcels(lots, buildings)
    assert sorted((r.lot, r.tong, r.ban) for r in parts.collect()) == [("1", 3, 2), ("1", 4, 0), ("2", 3, 2)]
    assert {r.tong: round(r.area, 6) for r in S.unit_layer(parts.select("tong", "geom"), "tong").collect()} == {3: 196, 4: 4}


def test_voronoi_parts_has_a_row_for_each_unit_of_a_box(spark):
    from lotweave.plans import space_queries as Q

    sf = "/root/testdata/sf0.01"
    at = Q.points(spark, sf).collect()
    want = {}
    for b in Q.large(spark, sf).collect():
        mine = [p for p in at if b.minx <= p.x <= b.maxx and b.miny <= p.y <= b.maxy]
        ring = np.array([[b.minx, b.miny], [b.maxx, b.miny], [b.maxx, b.maxy], [b.minx, b.maxy]])
        for p, c in zip(mine, shapes.voronoi(ring, np.array([(p.x, p.y) for p in mine]).reshape(-1, 2)), strict=True):
            want[b.box, p.tong] = want.get((b.box, p.tong), 0) + abs(shapes.ring_area(c))
    found = [((r.box, r.label), r.area) for r in Q.voronoi_parts(spark, sf).collect()]
    got = dict(found)
    assert len(found) == len(got) and set(got) == {k for k, a in want.items() if a >= 5}
    assert all(abs(a - want[k]) < 1e-6 for k, a in got.items())


@pytest.mark.parametrize("start", [(0, 0), (200_000, 600_000)])
def test_sites_on_one_circle_leave_no_land_out(start):
    # Four cells or more meet at one place: rounding gives them edges there of any direction.
    c, s = np.cos(0.3), np.sin(0.3)
    lattice = np.stack(np.meshgrid(np.arange(-10, 20, 0.7), np.arange(-10, 20, 0.7)), -1).reshape(-1, 2) @ np.array([[c, s], [-s, c]])
    circle = shapes.along(SQUARE, np.arange(40) / 40) - 5
    circle = 5 + 3 * circle / np.hypot(*circle.T)[:, None]
    for sites in (lattice, circle):
        for ring in (SQUARE, L_SHAPE, np.array([[5.0, -2], [12, 5], [5, 12], [-2, 5]])):
            cells = shapes.voronoi(ring + start, sites + start)
            assert abs(sum(abs(shapes.ring_area(x - x[0])) for x in cells if len(x)) - shapes.ring_area(ring)) < 1e-6
