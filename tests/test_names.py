from pyspark.sql import functions as F

from lotweave.operators import names as N


def test_apartment_index(spark):
    rows = [
        ("c", 1, 2, 1, "가람동 599-1 대우4차 101동 1~2라인, 102~104동"),
        ("c", 1, 2, 2, "배움1동 중 1통~31통 제외"),
        ("c", 3, 1, 3, "푸른마을(가동~다동)"),
        ("c", 3, 1, 4, "푸른마을 (가동~다동)"),
        ("c", 4, 1, 5, "12-3 101동"),
        ("c", 5, 1, 6, "994번지 풍림4차 A동"),
        ("c", 6, 1, 7, "101동 1호, 햇살 101동 2호"),
        ("c", 7, 1, 8, None),
    ]
    got = {tuple(r) for r in N.apartment_index(spark.createDataFrame(rows, "code string, tong int, ban int, row_no long, area string"), ["가람동"]).collect()}
    want = {("c", 1, 2, "대우4차", "대우4차", b, n) for b, n in [("101", "1~2라인"), ("102", ""), ("103", ""), ("104", "")]}
    want |= {("c", 3, 1, "푸른마을", "푸른마을", b, "") for b in "가나다"} | {("c", 5, 1, "풍림4차", "풍림4차", "A", "")}
    assert got == want


def test_greedy_pairs_follow_the_sorted_list(spark):
    import random

    rng = random.Random(3)
    data = list({(f"n{rng.randrange(12)}", f"c{rng.randrange(9)}"): rng.randrange(1, 30) for _ in range(80)}.items())
    rows = [(n, c, v) for (n, c), v in data]
    total = {}
    for n, _, v in rows:
        total[n] = total.get(n, 0) + v
    names, codes, want = set(), set(), []
    for v, n, c in sorted(((v, n, c) for n, c, v in rows if total[n] >= 10), reverse=True):
        if n not in names and c not in codes:
            names.add(n)
            codes.add(c)
            want.append((n, c, v, v / total[n] < 0.5 or v < 5))
    df = spark.createDataFrame(rows, "name string, code string, n long")
    assert sorted(map(tuple, N.greedy_pairs(df).collect())) == sorted(want)
    assert N.greedy_pairs(df.limit(0)).count() == 0


def test_waterfall_takes_the_first_source(spark):
    units = spark.createDataFrame([(1,), (2,), (3,)], "tong int")
    a = spark.createDataFrame([(1, "x", "1")], "tong int, legal string, lot string")
    b = spark.createDataFrame([(1, "y", "2"), (2, "y", "3")], "tong int, legal string, lot string")
    assert sorted(map(tuple, N.waterfall(units, a, b).collect())) == [(1, "x", "1", 0), (2, "y", "3", 1), (3, None, None, None)]


def test_mode_least(spark):
    df = spark.createDataFrame([(1, v) for v in (3, 3, 2, 2, 1)], "k int, v int")
    assert N.mode_least(df, ["k"], "v").select(F.col("mode")).first()[0] == 2


def test_lookup_review_and_known_lots(spark):
    index = spark.createDataFrame([("a", "1", 5), ("a", "산2", 6)], "legal string, lot string, tong int")
    asked = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3")], "legal string, lot string")
    assert sorted(map(tuple, N.lookup(index, asked).collect())) == [("a", "1", 5), ("a", "2", 6), ("a", "3", None)]
    missing = spark.createDataFrame([("d", 1, "why")], "dong string, tong int, reason string")
    fragments = spark.createDataFrame([("d", 2, 11, 250.5, ["x"]), ("d", 3, 5, 900.0, ["y", "z"])], "dong string, tong int, n long, d double, lots array<string>")
    omitted = spark.createDataFrame([("d", 4, "b"), ("d", 4, "a")], "dong string, tong int, lot string")
    rows = [tuple(r) for r in N.review_rows(missing, fragments, omitted).orderBy(*N.review_order()).collect()]
    assert rows == [("미표시", "d", 1, None, None, "why"), ("누락", "d", 4, 2, None, "a / b"), ("분리/지번오류의심", "d", 3, 5, 900, "y / z"), ("분리/블록분리", "d", 2, 11, 250, "x")]
    said = spark.createDataFrame([("c", "가람동 12-3 풍림 101동"), ("c", "나래동 4 풍림 102동")], "code string, area string")
    more = spark.createDataFrame([("c", "풍림 아파트", " 9 ")], "code string, apt_name string, lot string")
    assert [tuple(r) for r in N.known_lots(said, more, ["가람동"]).collect()] == [("c", "풍림", ["12-3", "9"])]


def test_numbered_counts_through_ranges(spark):
    from pyspark.sql import functions as F

    from lotweave.operators.tables import numbered

    rows = spark.range(0, 4000, 1, 7).select(F.expr("CASE WHEN id % 5 = 0 THEN NULL WHEN id % 50 = 1 THEN 'b' ELSE 'a' END").alias("g"), F.expr("CASE WHEN id % 9 > 0 THEN id * 37 % 101 END").alias("v"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that ranges stay apart
    try:
        assert rows.repartitionByRange("g", "v", "id").select(F.spark_partition_id()).distinct().count() > 4
        got = numbered(rows, "g", ["v", "id"], "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append(r)
    assert len(got) == 4000 and set(groups) == {None, "a", "b"}
    for own in groups.values():
        own.sort(key=lambda r: (r.v is not None, r.v or 0, r.id))
        assert [r.n for r in own] == list(range(1, len(own) + 1))
    assert numbered(rows.limit(0), "g", ["v", "id"], "n").count() == 0
