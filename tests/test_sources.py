import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotweave.geometry import projection, shapes
from lotweave.operators import names as N
from lotweave.sources import readers as R
from lotweave.sources import writers as W


def test_ledger_and_overrides(spark, tmp_path):
    (tmp_path / "a.csv").write_text('행정동,통,반,관할구역\r\n가람동,1,2,"491, 492"\r\n가람동,x,2,bad\r\n가람동, 3 ,1,"12-3(가, 나)"\r\n', encoding="utf-8-sig")
    got = R.read_ledger(spark, str(tmp_path / "a.csv")).orderBy("row_no").collect()
    assert [(r.admin_dong, r.tong, r.ban, r.area) for r in got] == [("가람동", 1, 2, "491, 492"), ("가람동", 3, 1, "12-3(가, 나)")]
    (tmp_path / "o.csv").write_text("code,통,반,법정동,지번,아파트,출처\n7,1,1,가람동,12-3,Y,x\n8,1,1,가람동,12-4,Y,x\n7,,1,가람동,9,Y,x\n", encoding="utf-8-sig")
    assert [tuple(r) for r in R.read_overrides(spark, str(tmp_path / "o.csv"), "7").collect()] == [("7", 1, 1, "가람동", "12-3", True)]


def test_json_and_configs(spark, tmp_path):
    (tmp_path / "codes.json").write_text(json.dumps({"_comment": ["x"], "가람": "31", "나래": "32"}, ensure_ascii=False), encoding="utf-8")
    assert sorted(map(tuple, R.read_keyed_json(spark, str(tmp_path / "codes.json"), "string").collect())) == [("가람", "31"), ("나래", "32")]
    (tmp_path / "n.json").write_text(json.dumps({"_c": 1, "a": {"x": 1, "y": [1, 2]}}))
    assert R.read_keyed_json(spark, str(tmp_path / "n.json"), "struct<x:int,y:array<int>>").first().value.y == [1, 2]
    good = {"admin_dong": "가람", "admin_code": "31", "legal_dongs": {"4139": "가람동"}, "target_beopjeong": ["가람동"], "table_csv": "t.csv"}
    (tmp_path / "c1.json").write_text(json.dumps(good), encoding="utf-8")
    c = R.read_configs(spark, str(tmp_path / "c1.json")).first()
    assert (c.conflict_policy, c.bonbun_fallback, c.road_jimok, c.road_split_sliver_m2) == ("min_tong", True, ["도"], 5.0)
    (tmp_path / "c2.json").write_text(json.dumps({**good, "table_csv": None}))
    with pytest.raises(Exception, match="table_csv"):
        R.read_configs(spark, str(tmp_path / "c2.json")).collect()
    assert R.pick(["Pnu", "JIBUN"], ["PNU", "pnu"]) == "Pnu" and R.pick(["a"], ["b"]) is None and R.pick(["pnu", "PNU"], ["PNU"]) == "PNU"


def hwpx(path, rows):
    cell = lambda paras: "<hp:tc>" + "".join(f"<hp:p><hp:run><hp:t>{p}</hp:t></hp:run></hp:p>" for p in paras) + "</hp:tc>"
    body = "".join("<hp:tr>" + "".join(map(cell, r)) + "</hp:tr>" for r in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("Contents/section0.xml", f'<hs:sec xmlns:hs="s" xmlns:hp="p"><hp:tbl>{body}</hp:tbl></hs:sec>')


def test_documents(spark, tmp_path):
    hwpx(tmp_path / "d.hwpx", [[["동명"], ["통"], ["반"], ["구역"]], [["가람"], ["1통"], ["1반 2반"], ["가람동 1", "2-3", "나래동 4"]], [["2통"], ["1반"], ["가람동 9", "", "다솜동 8"]], [["x"], ["y"]], [["나래"], ["3"], ["1"], ["5"]]])
    rows, wrong = R.read_documents(spark, str(tmp_path / "d.hwpx"))
    got = sorted((r.row_no, r.admin_dong, r.tong, r.ban, r.area) for r in rows.collect())
    assert got == [(1, "가람", 1, 1, "가람동 1 2-3"), (1, "가람", 1, 2, "나래동 4"), (2, "가람", 2, 1, "가람동 9"), (2, "가람", 2, 2, "다솜동 8"), (4, "나래", 3, 1, "5")]
    assert [(r.row_no, r.label) for r in wrong.collect()] == [(2, "1반")]


def shapefile(stem, records):
    """records: (attributes, rings), rings clockwise for outer ones."""
    names = list(records[0][0])
    dbf = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(records), 32 + 32 * len(names) + 1, 1 + 20 * len(names))
    dbf += b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([20, 0]) + b"\0" * 14 for n in names) + b"\r"
    dbf += b"".join(b" " + b"".join(v.encode("cp949").ljust(20) for v in a.values()) for a, _ in records)
    body = b""
    for k, (_, rings) in enumerate(records):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            closed = [np.vstack([r, r[:1]]) for r in rings]
            starts = np.cumsum([0, *map(len, closed)])
            content = struct.pack("<i4d", 5, 0, 0, 0, 0) + struct.pack("<ii", len(closed), int(starts[-1])) + starts[:-1].astype("<i4").tobytes() + np.vstack(closed).astype("<f8").tobytes()
        body += struct.pack(">II", k + 1, len(content) // 2) + content
    stem.with_suffix(".dbf").write_bytes(dbf)
    stem.with_suffix(".shp").write_bytes(struct.pack(">I20xI", 9994, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8) + body)


def test_shapefile_and_geojson(spark, tmp_path):
    square = np.array([[0.0, 0], [0, 10], [10, 10], [10, 0]])
    hole = np.array([[1.0, 1], [2, 1], [2, 2], [1, 2]])
    shapefile(tmp_path / "p", [({"PNU": "4139012700104910002", "JIBUN": "491-2 대"}, [square, hole, square + 20]), ({"PNU": "x", "JIBUN": ""}, None)])
    got = R.read_shapefile(spark, f"{tmp_path}/*.shp").orderBy("record").collect()
    assert got[0].attributes == {"PNU": "4139012700104910002", "JIBUN": "491-2 대"} and got[1].geom is None
    polygons = shapes.from_wkb(bytes(got[0].geom))
    assert [len(p) for p in polygons] == [2, 1] and sum(map(shapes.area, polygons)) == 199

    layer = R.read_shapefile(spark, f"{tmp_path}/*.shp").select(F.col("attributes.PNU").alias("pnu"), F.col("record").alias("tong"), "geom")
    (tmp_path / "layer.geojson").write_text(W.collection(layer), encoding="utf-8")
    back = R.read_geojson(spark, str(tmp_path / "layer.geojson"), "pnu string, tong int").orderBy("tong").collect()
    assert [(r.pnu, r.tong) for r in back] == [("4139012700104910002", 0), ("x", 1)] and back[1].geom is None
    assert sum(map(shapes.area, shapes.from_wkb(bytes(back[0].geom)))) == 199
    W.write_geojson(layer, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2


def test_reports_and_configs_are_written(spark, tmp_path):
    df = spark.createDataFrame([('가"1', 2, None), ("b", 1, "x")], "key string, tong int, note string")
    members = [r.value for r in W.keyed_json(df, "key").collect()]
    assert json.loads("{" + ",".join(members) + "}") == {'가"1': {"tong": 2, "note": None}, "b": {"tong": 1, "note": "x"}}
    W.write_report(df, str(tmp_path / "r"), ["tong"])
    assert [r.tong for r in spark.read.csv(str(tmp_path / "r"), header=True).collect()] == ["1", "2"]
    c = spark.createDataFrame([("1", "a")], "admin_code string, admin_dong string")
    W.write_configs(c, str(tmp_path / "c"))
    W.write_configs(spark.createDataFrame([("1", "z"), ("2", "b")], c.schema), str(tmp_path / "c"))
    assert sorted((r.admin_code, r.admin_dong) for r in spark.read.json(str(tmp_path / "c")).collect()) == [("1", "a"), ("2", "b")]
    W.write_configs(spark.createDataFrame([("1", "z")], c.schema), str(tmp_path / "c"), force=True)
    assert [r.admin_dong for r in spark.read.json(str(tmp_path / "c")).collect()] == ["z"]


PRJ = 'PROJCS["Korea_2000_Korea_Central_Belt_2010",GEOGCS["GCS_Korea_2000",DATUM["D_Korea_2000",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",200000.0],PARAMETER["False_Northing",600000.0],PARAMETER["Central_Meridian",127.0],PARAMETER["Scale_Factor",1.0],PARAMETER["Latitude_Of_Origin",38.0],UNIT["Meter",1.0]]'


def test_coordinate_systems():
    assert projection.system(PRJ) == projection.system("epsg:5186") and projection.system("EPSG:4326") is None
    assert projection.system(PRJ[PRJ.index("GEOGCS") : PRJ.index(",PROJECTION")]) is None
    for bad in ("EPSG:5174", PRJ.replace("6378137.0", "6377397.155"), PRJ.replace("Transverse_Mercator", "Lambert"), ""):
        with pytest.raises(ValueError):
            projection.system(bad)
    p = np.array([[126.8, 37.35], [127.5, 38.0]])
    metres = projection.move(p, "EPSG:4326", "EPSG:5179")
    assert np.allclose(metres[1], [1000000, 2000000], atol=1e-6)  # the belt's own origin
    assert np.allclose(projection.move(projection.move(metres, "EPSG:5179", PRJ), PRJ, "EPSG:4326"), p, atol=1e-9)


def test_boundaries(spark, tmp_path):
    square = np.array([[200000.0, 600000], [200000, 600100], [200100, 600100], [200100, 600000]])
    where = (str(tmp_path / "*.shp"), str(tmp_path / "*.zip"))
    assert R.read_boundaries(spark, *where).count() == 0
    shapefile(tmp_path / "b", [({"BASE": "1", "ADM_CD": "31", "CUT": "가람"}, [square]), ({"BASE": "2", "ADM_CD": "32", "CUT": "나래"}, [square + 100]), ({"BASE": "3", "ADM_CD": "33", "CUT": "x"}, None)])
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.write(tmp_path / "b.shp", "in/b.SHP")
        z.write(tmp_path / "b.dbf", "in/b.dbf")
        z.writestr("in/b.prj", PRJ)
    for name in (".shp", ".dbf"):
        (tmp_path / "b").with_suffix(name).rename(tmp_path / f"kept{name}.off")
    packed = [tuple(r) for r in R.read_boundaries(spark, *where, encoding="cp949").orderBy("code").collect()]
    for name in (".shp", ".dbf"):
        (tmp_path / f"kept{name}.off").rename((tmp_path / "b").with_suffix(name))
    loose = [tuple(r) for r in R.read_boundaries(spark, *where, encoding="cp949").orderBy("code").collect()]
    assert packed == loose and [r[:2] for r in loose] == [("31", "가람"), ("32", "나래")]
    corner = shapes.from_wkb(bytes(loose[0][2]))[0][0].min(0)
    assert np.allclose(corner, [127, 38], atol=1e-6)
    (only,) = R.read_boundaries(spark, *where, code="32", to="EPSG:5186", encoding="cp949").collect()
    assert only.code == "32" and abs(shapes.area(shapes.from_wkb(bytes(only.geom))[0]) - 10000) < 1e-6
    (tmp_path / "b.prj").write_text(PRJ)
    assert {r.crs for r in R.read_shapefile(spark, where[0]).collect()} == {PRJ}


def test_missing_inputs_and_folders(spark, tmp_path):
    (tmp_path / "31").mkdir()
    (tmp_path / "31" / "t.csv").write_text("행정동,통,반,관할구역\n가람동,1,2,491\n", encoding="utf-8")
    there, gone = str(tmp_path / "3*" / "t.csv"), str(tmp_path / "3*" / "none.csv")
    assert R.present(spark, there, gone) == [there]
    assert R.read_ledger(spark, there).select(R.folder_code(F.col("path"))).first()[0] == "31"
    assert spark.range(1).select(R.folder_code(F.lit("/a/b/t.csv"))).first()[0] is None


def workbook(path, sheet, rows):
    shared = sorted({v for r in rows for v in r if v})
    cell = lambda k, n, v: f'<c r="{chr(65 + k)}{n}" t="s"><v>{shared.index(v)}</v></c>' if k % 2 else f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{n}">' + "".join(cell(k, n, v) for k, v in enumerate(r) if v) + "</row>" for n, r in enumerate(rows, 1))
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="x" sheetId="1" r:id="rId1"/><sheet name="{sheet}" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="y"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">' + "".join(f"<si><r><t>{v}</t></r></si>" for v in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')


def test_reviews(spark, tmp_path):
    head = list(R.REVIEW_COLUMNS.values())
    workbook(tmp_path / "r.xlsx", R.REVIEW_SHEET, [head, ["가람", "해", "해맑은", "12-3", "", "O", ""], ["가람", "달", "달빛", "4", "달님", "", ""], ["가람", "별", "별빛", "5", "", "X", ""], ["가람", "솔", "솔빛", "6", "", "O", "O"], ["", "", "", "", "", "", ""]])
    got = R.read_reviews(spark, str(tmp_path / "r.xlsx"))
    rows = {r.seq: (r.name, r.value, r.lot, r.manual, r.status, r.basis) for r in got.collect()}
    assert rows[2] == ("해", "해맑은", "12-3", "", "O", R.CONFIRMED) and rows[3] == ("달", "달빛", "", "달님", "", R.BY_HAND) and sorted(rows) == [2, 3, 4, 6]
    old = spark.createDataFrame([("가람", "해", "해맑은")], "dong string, name string, value string")
    assert sorted(tuple(r) for r in N.merge_review(old, got, ["dong", "name"]).collect()) == [("가람", "달", "달님"), ("가람", "해", "해맑은")]
    with pytest.raises(Exception, match="no sheet"):
        R.read_reviews(spark, str(tmp_path / "r.xlsx"), "y").collect()
