import pytest
from pyspark.sql import functions as F

from lotweave.functions import lots
from lotweave.operators import ledger as L

# Specs and their lots; None: unreadable.
TABLE = {
    "491": ["491"],
    "12-3": ["12-3"],
    "": [],
    "169-35~38": ["169-35", "169-36", "169-37", "169-38"],
    "256-1ㆍ2ㆍ3": ["256-1", "256-2", "256-3"],
    "815-1~3ㆍ14~16": ["815-1", "815-2", "815-3", "815-14", "815-15", "815-16"],
    "7ㆍ9": ["7", "9"],
    "491~493-2": ["491", "492", "493", "493-2"],
    "1008~3": ["1008-3"],
    "40-9~3": [],
    "169-3~169-5": ["169-3", "169-4", "169-5"],
    "10-1~12-3": ["10", "11", "12-1", "12-2", "12-3"],
    "10-198~12-1": ["10-198", "10-199", "11", "12-1"],
    "1~2001": None,
    "1-2-3~5": None,
    "1~2~3": None,
    "5~": None,
    "1-1ㆍ9~": None,
}


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "s string").select(expression(F.col("s")).alias("v")).first().v


def test_spec_table(spark):
    df = spark.createDataFrame([(k,) for k in TABLE], "s string")
    got = {r.s: (r.a, r.b) for r in df.select("s", lots.expand_spec(F.col("s"), F.lit(False)).alias("a"), lots.expand_spec(F.col("s"), F.lit(True)).alias("b")).collect()}
    for k, want in TABLE.items():
        assert got[k][0] == want, k
        assert got[k][1] == (want and ["산" + x for x in want]) or want == got[k][1], k
    assert len(one(spark, "1~2000", lambda s: lots.expand_spec(s, F.lit(False)))) == 2000
    assert one(spark, "1~99999999999", lambda s: lots.expand_spec(s, F.lit(False))) is None
    assert one(spark, None, lambda s: lots.expand_spec(s, F.lit(False))) is None


def test_mountain_ranges(spark):
    want = {"산100-4~산102": ["산100", "산101", "산102", "산100-4"], "13-1~산13-3": ["산13-1", "산13-2", "산13-3"], "산74~산74": ["산74"], "산9~산8": [], "산5~산9999": [], "산1ㆍ2~산3": []}
    for k, v in want.items():
        assert one(spark, k, lots.expand_mountain_range) == v, k


def test_keys_and_names(spark):
    assert one(spark, "4139012700104910002", lots.pnu_lot) == "491-2"
    assert one(spark, " 4139012700200790000 ", lots.pnu_lot) == "산79"
    assert one(spark, "413901270010491", lots.pnu_lot) is None
    assert one(spark, "4139012700104910002", lots.pnu_district) == "4139012700"
    assert one(spark, "산 12-0 임", lots.jibun_lot) == "산12"
    assert one(spark, "1774-10 대", lambda s: lots.land_category(s, "raw")) == " 대"
    assert one(spark, "1774-10 대", lambda s: lots.land_category(s, "stripped")) == "대"
    assert one(spark, "39-18전", lots.land_category) == "전"
    assert one(spark, "12-345", lots.range_artifact) and not one(spark, "12-34", lots.range_artifact) and not one(spark, "400-345", lots.range_artifact)
    assert one(spark, " ｅ편한 세상 아파트Ⓐ", lots.search_name) == "이편한세상"
    assert one(spark, "풍림 101동, 103~105동 가동~다동 A동 (b동~d동", lots.buildings) == sorted(["101", "103", "104", "105", "가", "나", "다", "A", "B", "C", "D", "b"])
    assert one(spark, 11, lambda s: lots.grade(s.cast("int"))) == "블록분리"
    assert one(spark, 11, lambda s: lots.circular_distance(s.cast("int"), F.lit(1))) == 2


@pytest.mark.parametrize(("a", "b", "want"), [("aab", "aac", 0.5), ("abab", "ab", 2 * 2 / (3 + 1)), ("x", "xy", 0), ("", "a", 0), ("ab", "ab", 1), (None, "a", 0)])
def test_bigram(spark, a, b, want):
    assert abs(spark.createDataFrame([(a, b)], "a string, b string").select(lots.bigram_similarity(F.col("a"), F.col("b"))).first()[0] - want) < 1e-12


# Ledger texts and what they say, derived by hand: (kind, legal, lot, apt), in the ledger's order.
LEDGER = {
    "가람동 764-3, 9~10, 16": [("lot", "가람동", x, False) for x in ("764-3", "9", "10", "764-9", "764-10", "16", "764-16")],
    "가람동 491(푸른빌라 101호, 102호)": [("lot", "가람동", "491", True)],
    "가람동 771(부번지 포함)": [("lot", "가람동", "771", False)],
    "가람동 12-3, 나래동 5, 7": [("lot", "가람동", "12-3", False), ("lot", "나래동", "5", False), ("lot", "나래동", "7", False)],
    "가람동 12-3, 산4, 5": [("lot", "가람동", "12-3", False), ("lot", "가람동", "산4", False), ("lot", "가람동", "5", False)],
    "가람동 12-3, 40-9~3, 5": [("lot", "가람동", "12-3", False), ("failed", "가람동", "40-9~3", False), ("apartment", "가람동", "40-9~3", False), ("lot", "가람동", "5", False), ("lot", "가람동", "12-5", False)],
    "가람동 산100-4~산102": [("lot", "가람동", x, False) for x in ("산100", "산101", "산102", "산100-4")],
    "가람동 12-1, 13-1~산13-3, 5": [("lot", "가람동", x, False) for x in ("12-1", "산13-1", "산13-2", "산13-3", "5")],
    "하늘마을 501, 가람동 3번지": [("failed", "", "하늘마을 501", True), ("lot", "가람동", "3", False)],
    "가람동 하늘마을 501": [("apartment", "가람동", "하늘마을 501", True)],
    "마루동 5, 가람동 ": [("failed", "", "마루동 5", False)],
    "가람동 256-1 ㆍ 2ㆍ3 77": [("lot", "가람동", x, False) for x in ("256-1", "256-2", "256-3", "77", "256-77")],
    "": [],
    None: [],
}


def test_ledger_table(spark):
    rows = list(enumerate(LEDGER))
    got = {}
    found = L.expand_ledger(spark.createDataFrame(rows, "row_no long, area string"), ["가람동", "나래동"])
    for r in sorted(found.collect(), key=lambda r: (r.row_no, r.seg, -1 if r.at is None else r.at, r.kind != "failed", r.n)):
        got.setdefault(r.row_no, []).append((r.kind, r.legal, r.lot, r.apt))
    for k, area in rows:
        assert got.get(k, []) == LEDGER[area], area


def test_group_paragraphs_and_labels(spark):
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(["12-1", "13", "가람동 5", " 산 7", "9", "나래 1", "3"])], "c int, o int, t string")
    assert [(r.block, r.text) for r in L.group_paragraphs(df, "c", "o", "t").orderBy("block").collect()] == [(1, "12-1 13"), (2, "가람동 5  산 7 9"), (3, "나래 1 3")]
    assert one(spark, "1반2반3반", lambda s: L.label_mismatch(s, F.lit(3))) is False
    assert one(spark, "1반3반", lambda s: L.label_mismatch(s, F.lit(2))) is True


def test_territory_pairs_and_first_lots(spark):
    text = "가람동 491, 492~493(빌라 1호), 나래동 산12, 13-1,가람동5"
    got = one(spark, text, lots.territory_pairs)
    assert [tuple(x) for x in got] == [("가람동", "491"), ("가람동", "492"), ("가람동", "493"), ("나래동", "산12"), ("나래동", "13-1"), ("나래동", "가람동5")]
    assert one(spark, "491, 492", lots.territory_pairs) == [] and one(spark, "", lots.territory_pairs) == []
    assert tuple(one(spark, "x 가람동 산12-3, 나래동 4", lambda s: lots.first_lot(s, ["가람동"]))) == ("가람동", "산12-3")
    assert one(spark, "나래동 4 가람동 5", lambda s: lots.first_lot(s, ["가람동"])) is None
    assert [tuple(x) for x in one(spark, "나래동 4 가람동 5 가람동6-1", lambda s: lots.all_lots(s, ["가람동"]))] == [("가람동", "5"), ("가람동", "6-1")]
    assert one(spark, "가람동 12-3 풍림 마을 (101동 1호)", lots.cluster_name) == "풍림마을"


def test_earlier_readings(spark):
    for spec, older, oldest in [("491~3", [], []), ("10-1~12-3", ["10-1", "12-3", "11"], None), ("5-1~5-3", ["5-1", "5-2", "5-3"], None), ("7~9-2", ["7", "8", "9", "9-2"], ["7", "8", "9", "9-2"]), ("1~x", None, None)]:
        for mode, want in (("older", older), ("oldest", oldest)):
            assert one(spark, spec, lambda s, m=mode: lots.expand_spec(s, F.lit(False), m)) == want, (spec, mode)
