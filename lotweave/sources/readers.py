"""Readers of the domain's files. Files are found and read by Spark (any store it knows); parsing runs on executors."""

from __future__ import annotations

import io
import re
import struct
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotweave.geometry import shapes
from lotweave.operators.ledger import carry_forward, group_paragraphs, label_mismatch
from lotweave.operators.spatial import reproject

# Column names of the ledger and of override files, and the header cell of document tables.
LEDGER_COLUMNS = ("행정동", "통", "반", "관할구역")
HEADER_CELL = "동명"


def pick(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate that is a column, exactly or else but for case, candidate by candidate."""
    lower = {c.lower(): c for c in reversed(columns)}
    return next((c if c in columns else lower[c.lower()] for c in candidates if c in columns or c.lower() in lower), None)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(admin_dong, tong, ban, area, path, row_no) of ledger CSVs with a header; rows whose numbers aren't numbers go.

    row_no orders the rows of a file.
    """
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, quote='"', escape='"')
    dong, tong, ban, area = LEDGER_COLUMNS
    text = F.col(dong) if dong in raw.columns else F.lit(None).cast("string")
    out = raw.select(text.alias("admin_dong"), F.trim(tong).try_cast("int").alias("tong"), F.trim(ban).try_cast("int").alias("ban"), F.col(area).alias("area"), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("row_no"))
    return out.where("tong is not null and ban is not null")


def read_overrides(spark: SparkSession, path: str, code: str | None = None) -> DataFrame:
    """(code, tong, ban, legal, lot, apt) of lots that were confirmed by hand; all count as apartments."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", quote='"', escape='"')
    out = raw.select(F.trim("code").alias("code"), F.trim("통").try_cast("int").alias("tong"), F.trim("반").try_cast("int").alias("ban"), F.trim("법정동").alias("legal"), F.trim("지번").alias("lot"), F.lit(True).alias("apt"))
    out = out.where("tong is not null and ban is not null")
    return out.where(F.col("code") == code) if code else out


def read_keyed_json(spark: SparkSession, path: str, value: T.DataType | str) -> DataFrame:
    """(key, value) of a JSON object's members; keys that begin with _ are comments."""
    raw = spark.read.text(path, wholetext=True)
    kind = value if isinstance(value, str) else value.simpleString()
    # Comments may have another type than values: members are read as text first.
    members = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "text")).where(~F.col("key").startswith("_"))
    return members.select("key", (F.col("text") if kind == "string" else F.from_json("text", kind)).alias("value"))


# Required keys of a district's configuration, and defaults of the others.
REQUIRED = ("admin_dong", "admin_code", "legal_dongs", "target_beopjeong", "table_csv")
CONFIG = "admin_dong string, admin_code string, legal_dongs map<string,string>, target_beopjeong array<string>, table_csv string, shp_encoding string, source_crs_fallback string, conflict_policy string, bonbun_fallback boolean, clip_to_admin boolean, road_fill boolean, road_jimok array<string>, road_split_sliver_m2 double"
DEFAULTS = {"shp_encoding": "cp949", "source_crs_fallback": "EPSG:5186", "conflict_policy": "min_tong", "bonbun_fallback": True, "clip_to_admin": True, "road_fill": False, "road_split_sliver_m2": 5.0}


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each configuration, with defaults; one that lacks a required key stops the read."""
    out = spark.read.schema(CONFIG).json(path, multiLine=True)
    missing = F.concat_ws(", ", *[F.when(F.col(k).isNull(), F.lit(k)) for k in REQUIRED])
    out = out.withColumn("admin_code", F.when(missing == "", F.col("admin_code")).otherwise(F.raise_error(F.concat(F.lit("configuration lacks "), missing))))
    out = out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in DEFAULTS.items()})
    return out.withColumn("road_jimok", F.coalesce("road_jimok", F.array(F.lit("도"))))


def document_rows(data: bytes) -> list[tuple[int, list[str], list[str]]]:
    """Rows of all tables of a document: their number, the cells' texts and the last cell's paragraphs."""
    import xml.etree.ElementTree as ET

    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("Contents/section0.xml"))
    tag = lambda e: e.tag.rpartition("}")[2]
    every = lambda e, name: (x for x in e.iter() if tag(x) == name)
    text = lambda e: "".join(t.text or "" for t in every(e, "t")).strip()
    out = []
    for table in every(root, "tbl"):
        for row in every(table, "tr"):
            cells = [c for c in row if tag(c) == "tc"]
            if cells:
                out.append((len(out), [text(c) for c in cells], [p for p in map(text, every(cells[-1], "p")) if p]))
    return out


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ledger rows (path, row_no, admin_dong, tong, ban, area) and warnings (path, row_no, admin_dong, tong, label) of HWPX documents.

    Rows of four cells name their district, rows of three belong to the last one named; others, and repeated headers, are left
    out. A warning says that a row's label doesn't count its blocks.
    """

    def run(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = document_rows(content)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["path", "row_no", "cells", "paragraphs"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row_no int, cells array<string>, paragraphs array<string>")
    n = F.size("cells")
    rows = raw.where((n.isin(3, 4)) & (F.get("cells", F.lit(0)) != HEADER_CELL))
    named = F.when((n == 4) & (F.get("cells", F.lit(0)) != ""), F.get("cells", F.lit(0)))
    rows = carry_forward(rows.withColumn("admin_dong", named), ["path"], ["row_no"], "admin_dong").where("admin_dong is not null and size(paragraphs) > 0")
    rows = rows.withColumn("tong", F.regexp_replace(F.get("cells", n - 3), r"\D", "").try_cast("int")).withColumn("label", F.get("cells", n - 2))
    key = F.concat_ws("#", "path", "row_no")
    blocks = group_paragraphs(rows.select(key.alias("_k"), F.posexplode("paragraphs").alias("_at", "_p")), "_k", "_at", "_p")
    out = rows.select(key.alias("_k"), "path", "row_no", "admin_dong", "tong", "label").join(blocks, "_k")
    found = out.select("path", "row_no", "admin_dong", "tong", F.col("block").alias("ban"), F.col("text").alias("area"))
    wrong = out.groupBy("path", "row_no", "admin_dong", "tong", "label").agg(F.max("block").alias("n")).where(label_mismatch(F.col("label"), F.col("n"))).drop("n")
    return found, wrong


def shapefile_rows(shp: bytes, dbf: bytes, encoding: str, rename: dict[int, str] | None = None) -> list[tuple[dict, bytes | None]]:
    """Attributes and polygon (WKB, parts as a multipolygon) of each record; rename gives fields other names, by position."""
    (n,), (head, width) = struct.unpack_from("<I", dbf, 4), struct.unpack_from("<HH", dbf, 8)
    fields, at, k = [], 1, 32
    while dbf[k] != 0x0D:
        name = (rename or {}).get(len(fields)) or dbf[k : k + 11].split(b"\0")[0].decode(encoding, "replace")
        fields.append((name, at, dbf[k + 16]))
        at += dbf[k + 16]
        k += 32
    records = [{f: dbf[head + i * width + a : head + i * width + a + size].decode(encoding, "replace").strip() for f, a, size in fields} for i in range(n)]
    out, at = [], 100
    while at < len(shp) and len(out) < n:
        (size,) = struct.unpack_from(">I", shp, at + 4)
        (kind,) = struct.unpack_from("<i", shp, at + 8)
        geometry = None
        if kind in (5, 15, 25):
            parts, points = struct.unpack_from("<ii", shp, at + 44)
            starts = [*struct.unpack_from(f"<{parts}i", shp, at + 52), points]
            xy = np.frombuffer(shp, "<f8", 2 * points, at + 52 + 4 * parts).reshape(-1, 2)
            rings = [xy[a:b][:-1].astype(float) for a, b in zip(starts, starts[1:], strict=False)]
            outer = [r for r in rings if shapes.ring_area(r) <= 0] or rings  # outer rings run clockwise
            polygons = [[r] for r in outer]
            for hole in (r for r in rings if not any(r is o for o in outer)):
                home = next((p for p in polygons if shapes.contains([p[0]], hole[:1])[0]), polygons[0])
                home.append(hole)
            geometry = shapes.to_wkb(polygons[0]) if len(polygons) == 1 else struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(shapes.to_wkb, polygons))
        out.append((records[len(out)], geometry))
        at += 8 + 2 * size
    return out


def present(spark: SparkSession, *paths: str) -> list[str]:
    """Those of the paths or patterns that name at least one file; inputs that are missing are skipped by it."""
    conf = spark._jsc.hadoopConfiguration()

    def some(path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(conf).globStatus(p))

    return [p for p in paths if some(p)]


def folder_code(path: Column) -> Column:
    """The district code that a file's folder is named by; null if it isn't a number."""
    return F.nullif(F.regexp_extract(path, r"/(\d+)/[^/]+$", 1), F.lit(""))


SHAPES = "path string, record int, attributes map<string,string>, geom binary, crs string"


def _shape_batches(path: str, shp: bytes, dbf: bytes, encoding: str, crs: str | None, rename: dict[int, str]):
    rows = shapefile_rows(shp, dbf, encoding, rename)
    for k in range(0, len(rows), 4096):
        part = rows[k : k + 4096]
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(range(k, k + len(part)), pa.int32()), pa.array([list(r.items()) for r, _ in part], pa.map_(pa.string(), pa.string())), pa.array([g for _, g in part], pa.binary()), pa.array([crs] * len(part), pa.string())], names=["path", "record", "attributes", "geom", "crs"])


def read_shapefile(spark: SparkSession, path: str, encoding: str = "cp949", fallback: str = "EPSG:5186", rename: dict[int, str] | None = None) -> DataFrame:
    """(path, record, attributes map, geom, crs) of polygon shapefiles; path names .shp files, with a .dbf beside each.

    crs is the text of the .prj beside a file, and `fallback` where there is none. rename gives fields other names, by position.
    """
    files = spark.read.format("binaryFile")
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    beside = lambda end: re.sub(r"\.shp$", end, path)
    part = lambda found, name: files.load(found).select(stem.alias("path"), F.col("content").alias(name))
    both = part(path, "shp").join(part(beside(".dbf"), "dbf"), "path")
    if present(spark, beside(".prj")):
        both = both.join(part(beside(".prj"), "prj"), "path", "left")
    else:
        both = both.withColumn("prj", F.lit(None).cast("binary"))

    def run(batches):
        for b in batches:
            for p, shp, dbf, prj in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from _shape_batches(p, shp, dbf, encoding, prj.decode("utf-8", "replace") if prj else fallback, rename or {})

    return both.select("path", "shp", "dbf", "prj").mapInArrow(run, SHAPES)


# The code field of district boundaries, and the third field, whose name is cut within a character.
BOUNDARY_CODE, BOUNDARY_NAME = "ADM_CD", "ADM_NM"


def zipped_shapes(data: bytes) -> list[tuple[str, bytes, bytes, str | None]]:
    """Name, .shp, .dbf and text of the .prj of each shapefile in a zip file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {n.lower(): n for n in z.namelist()}
        stems = [n[:-4] for n in names if n.endswith(".shp") and n[:-4] + ".dbf" in names]
        read = lambda n: z.read(names[n])
        return [(names[s + ".shp"], read(s + ".shp"), read(s + ".dbf"), read(s + ".prj").decode("utf-8", "replace") if s + ".prj" in names else None) for s in stems]


def read_boundaries(spark: SparkSession, shp: str, zipped: str, code: str | None = None, to: str = "EPSG:4326", encoding: str = "UTF-8", fallback: str = "EPSG:5186") -> DataFrame:
    """(code, name, geom) of district boundaries, in the system `to`: of the .shp files, and if there are none of the zip files.

    Without either the table is empty. Records without a shape go.
    """
    names = {2: BOUNDARY_NAME}
    if present(spark, shp):
        found = read_shapefile(spark, shp, encoding, fallback, names)
    elif present(spark, zipped):

        def run(batches):
            for b in batches:
                for p, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for name, body, dbf, prj in zipped_shapes(data):
                        yield from _shape_batches(f"{p}/{name}", body, dbf, encoding, prj or fallback, names)

        found = spark.read.format("binaryFile").load(zipped).select("path", "content").mapInArrow(run, SHAPES)
    else:
        return spark.createDataFrame([], "code string, name string, geom binary")
    rows = found.select(F.col("attributes")[BOUNDARY_CODE].alias("code"), F.col("attributes")[BOUNDARY_NAME].alias("name"), "geom", "crs").where("geom is not null")
    return reproject(rows.where(F.col("code") == code) if code else rows, to).drop("crs")


def sheet_rows(data: bytes, sheet: str) -> list[tuple[int, dict[str, str]]]:
    """Number and cells (by the first row's titles) of each row of a workbook's sheet; cells that are empty are left out."""
    import xml.etree.ElementTree as ET

    local = lambda e: e.tag.rpartition("}")[2]
    every = lambda e, name: [x for x in e.iter() if local(x) == name]
    text = lambda e: "".join(t.text or "" for t in every(e, "t"))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = lambda n: ET.fromstring(z.read(n))
        ids = {s.get("name"): next(v for k, v in s.attrib.items() if k.endswith("}id")) for s in every(xml("xl/workbook.xml"), "sheet")}
        files = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        if sheet not in ids:
            raise ValueError(f"no sheet {sheet}")
        shared = [text(s) for s in every(xml("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        target = files[ids[sheet]]
        rows = every(xml(target.lstrip("/") if target.startswith("/") else f"xl/{target}"), "row")

    def cells(row) -> dict[str, str]:
        out = {}
        for c in (x for x in row if local(x) == "c"):
            value = next((x.text or "" for x in c if local(x) == "v"), "")
            if c.get("t") == "s":
                value = shared[int(value)]
            elif c.get("t") == "inlineStr":
                value = text(c)
            if value:
                out[re.sub(r"\d", "", c.get("r"))] = value.strip()
        return out

    titles = cells(rows[0]) if rows else {}
    return [(int(r.get("r")), {titles[k]: v for k, v in cells(r).items() if k in titles}) for r in rows[1:]]


# The review sheet, its titles, and what a row's alias rests on.
REVIEW_SHEET = "별칭검토"
REVIEW_COLUMNS = {"dong": "동", "name": "별표명", "value": "juso 공식 건물명(별칭)", "lot": "juso지번", "manual": "직접입력 별칭", "status": "채택(O/X)", "settled": "자동확정"}
BY_HAND, CONFIRMED = "담당자 직접입력", "담당자 확인(juso)"


def read_reviews(spark: SparkSession, path: str, sheet: str = REVIEW_SHEET) -> DataFrame:
    """(path, seq, dong, name, value, lot, manual, status, basis) of review workbooks; rows that were settled before are left out.

    An alias written by hand has no lot; blank cells are empty texts.
    """

    def run(batches):
        for b in batches:
            for p, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = sheet_rows(data, sheet)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int32()), pa.array([list(c.items()) for _, c in rows], pa.map_(pa.string(), pa.string()))], names=["path", "seq", "cells"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, seq int, cells map<string,string>")
    out = raw.select("path", "seq", *[F.coalesce(F.col("cells")[title], F.lit("")).alias(name) for name, title in REVIEW_COLUMNS.items()]).where("settled <> 'O'").drop("settled")
    by_hand = F.col("manual") != ""
    return out.withColumn("lot", F.when(by_hand, "").otherwise(F.col("lot"))).withColumn("basis", F.when(by_hand, BY_HAND).otherwise(CONFIRMED))


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Feature properties (a DDL list of them) and geom of GeoJSON polygons."""
    ring = "array<array<array<double>>>"
    schema = f"features array<struct<properties:struct<{', '.join(':'.join(p.split()) for p in properties.split(','))}>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    kind, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "MultiPolygon", F.from_json(coordinates, f"array<{ring}>")).when(kind == "Polygon", F.array(F.from_json(coordinates, ring)))

    def run(batches):
        for b in batches:
            geoms = []
            for polygons in b.column(b.schema.get_field_index("_parts")).to_pylist():
                p = [[np.array(r, float)[:-1, :2] for r in rings] for rings in polygons or []]
                geoms.append(None if not p else shapes.to_wkb(p[0]) if len(p) == 1 else struct.pack("<BII", 1, 6, len(p)) + b"".join(map(shapes.to_wkb, p)))
            keep = [n for n in b.schema.names if n != "_parts"]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in keep], pa.array(geoms, pa.binary())], names=[*keep, "geom"])

    rows = f.select("f.properties.*", parts.alias("_parts"))
    return rows.mapInArrow(run, T.StructType([x for x in rows.schema.fields if x.name != "_parts"] + [T.StructField("geom", T.BinaryType())]))
