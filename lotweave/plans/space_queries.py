"""Spatial queries, each with the SQL it is held against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotweave.geometry import shapes
from lotweave.operators import spatial as S
from lotweave.plans.proxy import frame, read, sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

P = sql("point")
#: A box for each supplier and customer, on a plane of some kilometres.
_BOX = "{0} AS box, CAST(({0} * 37) % 997 AS DOUBLE) AS minx, CAST(({0} * 53) % 991 AS DOUBLE) AS miny, CAST(({0} * 37) % 997 + 3 + {0} % 7 AS DOUBLE) AS maxx, CAST(({0} * 53) % 991 + 3 + {0} % 5 AS DOUBLE) AS maxy"
BOX = f"(SELECT {_BOX.format('c_custkey')} FROM customer)"
LARGE = "(SELECT n_nationkey AS box, CAST(-400 + (n_nationkey % 5) * 150 AS DOUBLE) AS minx, CAST(-400 + (n_nationkey // 5) * 150 AS DOUBLE) AS miny, CAST(-400 + (n_nationkey % 5) * 150 + 170 AS DOUBLE) AS maxx, CAST(-400 + (n_nationkey // 5) * 150 + 160 AS DOUBLE) AS maxy FROM nation)"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def points(spark, sf):
    return frame(spark, sf, "point")


def boxes(spark, sf):
    return read(spark, sf, "customer").selectExpr(*[x for x in _BOX.format("c_custkey").split(", ")])


def large(spark, sf):
    n = read(spark, sf, "nation")
    x, y = F.lit(-400.0) + (F.col("n_nationkey") % 5) * 150, F.lit(-400.0) + F.floor(F.col("n_nationkey") / 5) * 150
    return n.select(F.col("n_nationkey").alias("box"), x.alias("minx"), y.alias("miny"), (x + 170).alias("maxx"), (y + 160).alias("maxy"))


@query("grid_within", f"SELECT p.id, min(b.box) AS box FROM {P} p LEFT JOIN {LARGE} b ON p.x BETWEEN minx AND maxx AND p.y BETWEEN miny AND maxy GROUP BY p.id")
def grid_within(spark, sf):
    return S.first_box(points(spark, sf), large(spark, sf), 150.0).select("id", "box")


@query("points_in_boxes", f"SELECT p.id, b.box FROM {P} p JOIN {LARGE} b ON p.x BETWEEN minx AND maxx AND p.y BETWEEN miny AND maxy")
def points_in_boxes(spark, sf):
    return S.points_in_boxes(points(spark, sf), large(spark, sf), 150.0)


@query("within_distance", f"SELECT a.id, b.id AS other, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d FROM {P} a JOIN {P} b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 225 WHERE a.tong < 5 AND b.tong >= 5")
def within_distance(spark, sf):
    p = points(spark, sf)
    return S.within_distance(p.where("tong < 5"), p.where("tong >= 5"), 15.0).withColumn("d", F.round("d", 6))


@query("nearest", f"SELECT id, other, round(d, 6) AS d FROM (SELECT a.id, b.id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS r FROM {P} a, {P} b WHERE a.tong < 8 AND b.tong >= 8) WHERE r = 1")
def nearest(spark, sf):
    p = points(spark, sf)
    return S.nearest(p.where("tong < 8"), p.where("tong >= 8"), 20.0).withColumn("d", F.round("d", 6))


_GAP = "sqrt(pow(greatest(0, greatest(b.minx - a.maxx, a.minx - b.maxx)), 2) + pow(greatest(0, greatest(b.miny - a.maxy, a.miny - b.maxy)), 2))"


@query("adjacency_pairs", f"SELECT a.box, b.box AS other FROM {BOX} a JOIN {BOX} b ON a.box < b.box AND {_GAP} <= 5")
def adjacency_pairs(spark, sf):
    return S.box_pairs(boxes(spark, sf), 5.0, 16.0)


_LINKS = f"(SELECT a.id, b.id AS other FROM {P} a JOIN {P} b ON a.tong = b.tong AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600)"
_CLUSTERS = f"(WITH RECURSIVE e AS MATERIALIZED {_LINKS}, r AS (SELECT id, id AS root FROM {P} UNION SELECT e.other, r.root FROM r JOIN e ON e.id = r.id) SELECT id, min(root) AS root FROM r GROUP BY id)"


@query("components", f"SELECT * FROM {_CLUSTERS}")
def components(spark, sf):
    return S.linked_clusters(points(spark, sf), "tong", 40.0)


@query("detached", f"""WITH c AS MATERIALIZED {_CLUSTERS}, m AS MATERIALIZED (SELECT c.root, p.* FROM {P} p JOIN c ON c.id = p.id), s AS (SELECT tong, root, count(*) AS n, row_number() OVER (PARTITION BY tong ORDER BY count(*) DESC, root) AS r FROM m GROUP BY 1, 2),
d AS (SELECT a.tong, a.root, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM m a JOIN s ON s.tong = a.tong AND s.r = 1 JOIN m b ON b.tong = a.tong AND b.root = s.root WHERE a.root <> s.root GROUP BY 1, 2)
SELECT d.tong, d.root, s.n, round(d.d, 6) AS d FROM d JOIN s ON s.tong = d.tong AND s.root = d.root WHERE d.d >= 60""")
def detached(spark, sf):
    p = points(spark, sf)
    return S.detached(p, S.linked_clusters(p, "tong", 40.0), "tong", 60.0, 80.0).withColumn("d", F.round("d", 6))


@query("omission_majority", f"""WITH n AS (SELECT a.id, b.tong, count(*) AS n FROM {P} a JOIN {P} b ON a.tong < 3 AND b.tong >= 3 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900 GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY id) AS t, row_number() OVER (PARTITION BY id ORDER BY n DESC, tong) AS k FROM n) SELECT id, tong, n FROM r WHERE k = 1 AND n >= 0.6 * t""")
def omission_majority(spark, sf):
    p = points(spark, sf)
    return S.omissions(p.where("tong < 3"), p.where("tong >= 3"), 30.0, 0.6)


def _geom(df):
    """Boxes as WKB polygons, written by a kernel."""
    import numpy as np
    import pyarrow as pa

    kinds = dict(df.dtypes)

    def run(batches):
        for b in batches:
            ids, *sides = (c.to_pylist() for c in b.columns)
            geoms = [shapes.to_wkb([np.array([[x1, y1], [x2, y1], [x2, y2], [x1, y2]])]) for x1, y1, x2, y2 in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(geoms, pa.binary())], names=["box", "minx", "miny", "maxx", "maxy", "geom"])

    return df.select("box", "minx", "miny", "maxx", "maxy").mapInArrow(run, f"box {kinds['box']}, minx double, miny double, maxx double, maxy double, geom binary")


@query("bbox_area_shoelace", f"SELECT box, (maxx - minx) * (maxy - miny) AS area, 2 * (maxx - minx + maxy - miny) AS length, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy FROM {BOX}")
def bbox_area_shoelace(spark, sf):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rings = [shapes.from_wkb(g)[0] for g in b.column(1).to_pylist()]
            middle = [shapes.centroid(r[0]) for r in rings]
            columns = [[shapes.area(r) for r in rings], [shapes.length(r[0]) for r in rings], [c[0] for c in middle], [c[1] for c in middle]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.float64()) for c in columns]], names=["box", "area", "length", "cx", "cy"])

    return _geom(boxes(spark, sf)).select("box", "geom").mapInArrow(run, "box bigint, area double, length double, cx double, cy double")


@query("points_in_polygons", f"SELECT p.id, b.box FROM {P} p JOIN {LARGE} b ON p.x > minx AND p.x < maxx AND p.y > miny AND p.y < maxy")
def points_in_polygons(spark, sf):
    return S.points_in_polygons(points(spark, sf).select("id", "x", "y"), _geom(large(spark, sf)), 150.0)


@query("half_plane_split", f"""SELECT box, 's' AS part, (least(maxy, 500.0) - miny) * (maxx - minx) AS area FROM {BOX} WHERE miny < 500 UNION ALL SELECT box, 'n', (maxy - greatest(miny, 500.0)) * (maxx - minx) FROM {BOX} WHERE maxy > 500""")
def half_plane_split(spark, sf):
    return S.half_plane_split(boxes(spark, sf), F.lit(500.0))


@query("coverage_filter", f"""SELECT l.n_regionkey AS block, count(*) AS n, round(sum((maxx - minx) * (maxy - miny)) / 100000.0, 9) AS share FROM {BOX} b JOIN customer c ON c.c_custkey = b.box JOIN nation l ON l.n_nationkey = c.c_nationkey GROUP BY 1 HAVING count(*) >= 2 AND sum((maxx - minx) * (maxy - miny)) / 100000.0 >= 0.01""")
def coverage_filter(spark, sf):
    parcel = boxes(spark, sf).join(read(spark, sf, "customer"), F.col("box") == F.col("c_custkey")).join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    parcel = parcel.select(F.col("n_regionkey").alias("block"), ((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias("area"))
    block = read(spark, sf, "region").select(F.col("r_regionkey").alias("block"), F.lit(100000.0).alias("area"))
    return S.coverage(block, parcel, 2, 0.01).withColumn("share", F.round("share", 9))


@query("road_stats", """SELECT coalesce(c_mktsegment, 'all') AS hw, count(*) AS n, round(sum(abs(c_acctbal)) / 1000, 6) AS km, round(100.0 * CAST(count(*) FILTER (c_acctbal > 0) AS DOUBLE) / count(*), 6) AS named_pct FROM customer GROUP BY ROLLUP (c_mktsegment)""")
def road_stats(spark, sf):
    c = read(spark, sf, "customer").rollup("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum(F.abs("c_acctbal")) / 1000, 6).alias("km"), F.round(100.0 * F.count_if(F.col("c_acctbal") > 0) / F.count("*"), 6).alias("named_pct"))
    return c.select(F.coalesce("c_mktsegment", F.lit("all")).alias("hw"), "n", "km", "named_pct")


@query("manifest_extent", f"SELECT tong, round(min(x), 6) AS west, round(min(y), 6) AS south, round(max(x), 6) AS east, round(max(y), 6) AS north, round((min(x) + max(x)) / 2, 6) AS cx, round((min(y) + max(y)) / 2, 6) AS cy, count(*) AS n FROM {P} GROUP BY tong")
def manifest_extent(spark, sf):
    e = points(spark, sf).groupBy("tong").agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"), F.count("*").alias("n"))
    r = lambda c: F.round(c, 6)
    return e.select("tong", *[r(F.col(c)).alias(c) for c in ("west", "south", "east", "north")], r((F.col("west") + F.col("east")) / 2).alias("cx"), r((F.col("south") + F.col("north")) / 2).alias("cy"), "n")


#: Tiles of a lattice, a row an order line's part and supplier, for unions with known area.
_TILE = "p_partkey % 50 AS i, p_partkey // 50 AS j, CAST((p_partkey % 50) // 7 AS BIGINT) AS k FROM part"


@query("dissolve", f"SELECT k, CAST(count(*) AS DOUBLE) AS area FROM (SELECT DISTINCT {_TILE}) GROUP BY k")
def dissolve(spark, sf):
    p = read(spark, sf, "part").select((F.col("p_partkey") % 50).alias("i"), F.floor(F.col("p_partkey") / 50).alias("j")).distinct()
    p = p.select(F.floor(F.col("i") / 7).alias("k"), (F.col("j") * 50 + F.col("i")).alias("box"), F.col("i").cast("double").alias("minx"), F.col("j").cast("double").alias("miny"), (F.col("i") + 1).cast("double").alias("maxx"), (F.col("j") + 1).cast("double").alias("maxy"))
    return S.dissolve(_geom(p).join(p.select("box", "k"), "box").select("k", "geom"), "k").select("k", "area")


@query("coloring")
def coloring(spark, sf):
    """Greedy and so sequential within a district; tests check that neighbours differ."""
    b = boxes(spark, sf)
    district = (F.col("box") % 25).cast("int")
    pairs = S.box_pairs(b, 12.0, 16.0).where((F.col("box") % 25) == (F.col("other") % 25))
    return S.color(b.select(district.alias("district"), F.col("box").alias("id")), pairs.select(district.alias("district"), F.col("box").alias("id"), "other"), "district")


@query("voronoi", f"""SELECT box, round(sum(area), 4) AS area FROM (SELECT box, (maxx - minx) * (maxy - miny) AS area FROM {LARGE} b WHERE EXISTS (SELECT 1 FROM {P} p WHERE p.x BETWEEN minx AND maxx AND p.y BETWEEN miny AND maxy)) GROUP BY box""")
def voronoi(spark, sf):
    """The parts of each box nearest to its points' units add up to the box."""
    hit = S.points_in_boxes(points(spark, sf), large(spark, sf), 150.0).join(points(spark, sf), "id")
    parts = S.voronoi_split(_geom(large(spark, sf)).select("box", "geom"), hit.select("box", F.col("tong").alias("label"), "x", "y"), "box", 0.0)
    return parts.groupBy("box").agg(F.round(F.sum("area"), 4).alias("area"))


@query("voronoi_parts")
def voronoi_parts(spark, sf):
    hit = S.points_in_boxes(points(spark, sf), large(spark, sf), 150.0).join(points(spark, sf), "id")
    return S.voronoi_split(_geom(large(spark, sf)).select("box", "geom"), hit.select("box", F.col("tong").alias("label"), "x", "y"), "box", 5.0).select("box", "label", "area")


@query("polygonize", "SELECT r_regionkey AS district, CAST(20 AS BIGINT) AS n, CAST(20 * (r_regionkey + 1) AS DOUBLE) AS area FROM region")
def polygonize(spark, sf):
    """Streets on a lattice of 5 by 4 blocks in each district."""
    r = read(spark, sf, "region").select(F.col("r_regionkey").alias("district"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k"))
    w = (F.col("district") + 1).cast("double")
    lattice = r.select("district", F.when(F.col("k") < 6, F.col("k") * w).otherwise(-1.0).alias("x1"), F.when(F.col("k") < 6, -1.0).otherwise(F.col("k") - 6.0).alias("y1"), F.when(F.col("k") < 6, F.col("k") * w).otherwise(5 * w + 1).alias("x2"), F.when(F.col("k") < 6, 5.0).otherwise(F.col("k") - 6.0).alias("y2"))
    return S.polygonize(lattice, "district", 0.5).groupBy("district").agg(F.count("*").alias("n"), F.round(F.sum("area"), 6).alias("area"))


@query("simplify")
def simplify(spark, sf):
    """Walks of each user's events, simplified; tests hold the kernel against its definition."""
    import numpy as np
    import pyarrow as pa

    e = read(spark, sf, "events").select("user_id", "ts", "event_id", "value")

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(table.column("event_id")), np.asarray(table.column("ts").cast(pa.int64()))))
        v = np.asarray(table.column("value"))[order]
        line = np.stack([np.arange(len(v), dtype=float), v], 1)
        return pa.table({"user_id": table.column("user_id").slice(0, 1), "before": pa.array([len(line)], pa.int32()), "after": pa.array([len(shapes.simplify(line, 12.0)) if len(line) > 2 else len(line)], pa.int32())})

    return e.groupBy("user_id").applyInArrow(run, "user_id bigint, before int, after int")
