"""Queries over complexes, aliases, votes, reviews and audits, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotweave.functions import lots
from lotweave.operators import names as N
from lotweave.operators.assign import top_lots
from lotweave.operators.tables import numbered
from lotweave.plans.lot_queries import ASSIGNED, LEDGER, PARCEL, assigned, ledger, parcels
from lotweave.plans.proxy import ORDER, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


#: A ledger row for each part: a complex with buildings in one of several ways.
_AREA = """CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN '가람동 ' || CAST(p_partkey AS STRING) || '-1 ' || p_brand || ' 101~' || CAST(101 + p_partkey % 45 AS STRING) || '동 7호~9호, 205동 12호'
 WHEN 1 THEN '나래동 ' || p_brand || '2차 가동~라동' WHEN 2 THEN '가람동 12 ' || p_brand || ' A동~C동, b동' WHEN 3 THEN '배움1동 중 1통~31통 제외' WHEN 4 THEN p_brand || '(나동' ELSE '가람동 ' || CAST(p_partkey AS STRING) END"""


@query("apartment_ranges", f"""WITH t AS (SELECT p_partkey AS id, {_AREA} AS s FROM part), x AS (SELECT id, s,
 regexp_extract_all(s, '([0-9]+)\\s*동?\\s*[~～\\-]\\s*([0-9]+)\\s*동', 1) AS na, regexp_extract_all(s, '([0-9]+)\\s*동?\\s*[~～\\-]\\s*([0-9]+)\\s*동', 2) AS nb,
 regexp_extract_all(s, '(?:^|[\\s(（])([가나다라마바사아자차카타파하])\\s*동?\\s*[~～\\-]\\s*([가나다라마바사아자차카타파하])\\s*동', 1) AS ka, regexp_extract_all(s, '(?:^|[\\s(（])([가나다라마바사아자차카타파하])\\s*동?\\s*[~～\\-]\\s*([가나다라마바사아자차카타파하])\\s*동', 2) AS kb,
 regexp_extract_all(s, '(?:^|[\\s(（])([A-Za-z])\\s*동?\\s*[~～\\-]\\s*([A-Za-z])\\s*동', 1) AS aa, regexp_extract_all(s, '(?:^|[\\s(（])([A-Za-z])\\s*동?\\s*[~～\\-]\\s*([A-Za-z])\\s*동', 2) AS ab FROM t),
b AS (SELECT id, unnest(regexp_extract_all(s, '([0-9]+)\\s*동', 1)) AS b FROM x UNION SELECT id, unnest(regexp_extract_all(s, '(?:^|[\\s(（])([가나다라마바사아자차카타파하])동', 1)) FROM x UNION SELECT id, unnest(regexp_extract_all(s, '(?:^|[\\s(（])([A-Za-z])동', 1)) FROM x
 UNION SELECT id, CAST(unnest(generate_series(a, b)) AS VARCHAR) FROM (SELECT id, CAST(unnest(na) AS INT) AS a, CAST(unnest(nb) AS INT) AS b FROM x) WHERE b - a > 0 AND b - a < 40
 UNION SELECT id, substr('가나다라마바사아자차카타파하', unnest(generate_series(a, b))::INT, 1) FROM (SELECT id, strpos('가나다라마바사아자차카타파하', unnest(ka)) AS a, strpos('가나다라마바사아자차카타파하', unnest(kb)) AS b FROM x) WHERE a <= b
 UNION SELECT id, chr(unnest(generate_series(a, b))::INT) FROM (SELECT id, ascii(upper(unnest(aa))) AS a, ascii(upper(unnest(ab))) AS b FROM x) WHERE a <= b)
SELECT id, b AS building FROM b""")
def apartment_ranges(spark, sf):
    t = read(spark, sf, "part").selectExpr("p_partkey AS id", f"{_AREA} AS s")
    return t.select("id", F.explode(lots.buildings(F.col("s"))).alias("building"))


@query("apartment_index")
def apartment_index(spark, sf):
    """Needs look-ahead for the notes, which DuckDB's patterns lack; tests hold it against plain Python."""
    t = read(spark, sf, "part").selectExpr("CAST(p_partkey % 20 AS STRING) AS code", "CAST(p_partkey % 30 AS INT) AS tong", "p_size AS ban", "p_partkey AS row_no", f"{_AREA} AS area")
    return N.apartment_index(t, ["가람동", "나래동"])


_BIGRAMS = "CASE WHEN length({0}) < 2 THEN [] ELSE list_transform(generate_series(1, length({0}) - 1), lambda i: substr({0}, i, 2)) END"
_SIMILAR = f"""CASE WHEN {{0}} = '' OR {{1}} = '' THEN 0.0::DOUBLE WHEN {{0}} = {{1}} THEN 1.0 WHEN length({{0}}) < 2 OR length({{1}}) < 2 THEN 0.0
 ELSE 2.0 * len(list_filter({_BIGRAMS.format("{0}")}, lambda x: list_contains({_BIGRAMS.format("{1}")}, x))) / (len({_BIGRAMS.format("{0}")}) + len(list_distinct({_BIGRAMS.format("{1}")}))) END"""


@query("alias_bigram", f"SELECT p_partkey AS id, round({_SIMILAR.format('p_name', 'p_type')}, 9) AS similarity, round({_SIMILAR.format('p_brand', 'p_name')}, 9) AS other FROM part")
def alias_bigram(spark, sf):
    p = read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.round(lots.bigram_similarity(F.col("p_name"), F.col("p_type")), 9).alias("similarity"), F.round(lots.bigram_similarity(F.col("p_brand"), F.col("p_name")), 9).alias("other"))


#: Candidates of a name: three made-up official names with lots.
_CAND = """SELECT p_partkey AS id, n, CASE CAST((p_partkey + n) % 7 AS INT) WHEN 0 THEN p_name WHEN 1 THEN p_name || '2차' WHEN 2 THEN p_brand || ' 상가' WHEN 3 THEN p_type WHEN 4 THEN '' WHEN 5 THEN p_name || ' 아파트' ELSE p_name || ' 관리사무소' END AS official,
 CASE WHEN (p_partkey * 3 + n) % 11 = 0 THEN '12-3' ELSE CAST(n AS STRING) END AS lot FROM part CROSS JOIN (VALUES (1), (2), (3)) v(n) WHERE p_size <> 7"""
_FORM = "replace(replace(regexp_replace(lower(regexp_replace({0}, '\\s+', '', 'g')), '아파트|ⓐ|ａ', '', 'g'), 'ｅ', 'e'), 'e편한세상', '이편한세상')"


@query("alias_cascade", f"""WITH c AS (SELECT p_partkey AS id, p_name AS name, {_FORM.format("p_name")} AS key, n, official, lot, {_FORM.format("official")} AS form FROM part LEFT JOIN ({_CAND}) k ON k.id = p_partkey),
g AS (SELECT *, coalesce(lot = '12-3', false) AS hit, coalesce(form <> '' AND (lot = '12-3' OR NOT regexp_matches(official, '{N.NON_HOME}') OR regexp_matches(name, '{N.NON_HOME}')), false) AS good FROM c),
a AS (SELECT id, any_value(key) AS key, count(DISTINCT form) FILTER (good AND hit AND form <> key) AS n_lot, count(DISTINCT form) FILTER (good AND length(key) >= 4 AND form <> key AND (contains(key, form) OR contains(form, key))) AS n_name,
 bool_or(good AND form = key) AS same, bool_or(good) AS some_, string_agg(official, ';' ORDER BY n) FILTER (good AND hit AND form <> key AND NOT dup_lot) AS l, string_agg(official, ';' ORDER BY n) FILTER (good AND length(key) >= 4 AND form <> key AND (contains(key, form) OR contains(form, key)) AND NOT dup_name) AS m,
 arg_max(official, s - n * 1e-9) FILTER (good) AS b FROM (SELECT *, {_SIMILAR.format("key", "form")} AS s,
 EXISTS (SELECT 1 FROM g o WHERE o.id = g.id AND o.form = g.form AND o.n < g.n AND o.good AND o.hit) AS dup_lot, EXISTS (SELECT 1 FROM g o WHERE o.id = g.id AND o.form = g.form AND o.n < g.n AND o.good) AS dup_name FROM g) GROUP BY id)
SELECT id, coalesce(CASE WHEN n_lot > 0 THEN l WHEN n_name >= 1 THEN m WHEN same OR NOT some_ THEN '' ELSE b END, '') AS aliases, CASE WHEN n_lot > 0 THEN '지번일치' WHEN n_name = 1 THEN '이름확장(단일후보)' WHEN n_name > 1 THEN '이름확장(다수후보)' WHEN same OR NOT some_ THEN '' ELSE '유사후보' END AS basis,
 CASE WHEN n_lot > 0 OR n_name = 1 THEN 'O' WHEN n_name > 1 THEN 'X' WHEN same THEN '-' ELSE 'X' END AS status FROM a""")
def alias_cascade(spark, sf):
    p = read(spark, sf, "part")
    names = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(F.lit("12-3")).alias("lots"))
    three = p.where("p_size <> 7").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    official = """CASE CAST((p_partkey + n) % 7 AS INT) WHEN 0 THEN p_name WHEN 1 THEN p_name || '2차' WHEN 2 THEN p_brand || ' 상가' WHEN 3 THEN p_type WHEN 4 THEN '' WHEN 5 THEN p_name || ' 아파트' ELSE p_name || ' 관리사무소' END AS official"""
    cand = three.selectExpr("p_partkey AS id", "n", official, "CASE WHEN (p_partkey * 3 + n) % 11 = 0 THEN '12-3' ELSE CAST(n AS STRING) END AS lot")
    return N.match_aliases(names, cand).select("id", F.array_join("aliases", ";").alias("aliases"), "basis", "status")


@query("review_merge", """WITH r AS (SELECT c_nationkey AS code, c_mktsegment AS name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_custkey % 17 AS VARCHAR) END AS value, CASE WHEN c_custkey % 7 = 0 THEN ' m' || CAST(c_custkey % 3 AS VARCHAR) ELSE NULL END AS manual, CASE WHEN c_custkey % 2 = 0 THEN 'o' ELSE 'X' END AS status FROM customer),
o AS (SELECT DISTINCT CAST(s_nationkey AS INT) AS code, 'BUILDING' AS name, CAST(s_suppkey % 17 AS VARCHAR) AS value FROM supplier), n AS (SELECT DISTINCT code, name, CASE WHEN coalesce(trim(manual), '') <> '' THEN trim(manual) ELSE value END AS value FROM r WHERE upper(status) = 'O' OR coalesce(trim(manual), '') <> '')
SELECT code, name, value FROM o UNION ALL SELECT * FROM n WHERE value <> '' AND NOT EXISTS (SELECT 1 FROM o WHERE o.code = n.code AND o.name = n.name AND o.value = n.value)""")
def review_merge(spark, sf):
    r = read(spark, sf, "customer").selectExpr("c_nationkey AS code", "c_mktsegment AS name", "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_custkey % 17 AS STRING) END AS value", "CASE WHEN c_custkey % 7 = 0 THEN ' m' || CAST(c_custkey % 3 AS STRING) END AS manual", "CASE WHEN c_custkey % 2 = 0 THEN 'o' ELSE 'X' END AS status", "c_custkey AS seq")
    old = read(spark, sf, "supplier").selectExpr("CAST(s_nationkey AS INT) AS code", "'BUILDING' AS name", "CAST(s_suppkey % 17 AS STRING) AS value").distinct()
    return N.merge_review(old, r, ["code", "name"])


_VOTES = f"""(WITH p AS (SELECT DISTINCT CAST(id % 3 AS INT) AS dong, lot, legal AS code FROM {PARCEL}), s AS (SELECT dong, lot, min(code) AS code FROM p GROUP BY 1, 2 HAVING count(*) = 1),
 l AS (SELECT tong % 3 AS dong, lot, 'N' || CAST((tong + ban) % 6 AS VARCHAR) AS name FROM {LEDGER}) SELECT name, code, count(*) AS n FROM l JOIN s ON s.dong = l.dong AND s.lot = l.lot GROUP BY 1, 2)"""


def _votes(spark, sf):
    p = parcels(spark, sf).select((F.col("id") % 3).cast("int").alias("dong"), "lot", F.col("legal").alias("code"))
    said = ledger(spark, sf).select((F.col("tong") % 3).alias("dong"), "lot", F.concat(F.lit("N"), ((F.col("tong") + F.col("ban")) % 6).cast("string")).alias("name"))
    return N.votes(said, p)


@query("legal_code_votes", f"SELECT * FROM {_VOTES}")
def legal_code_votes(spark, sf):
    return _votes(spark, sf)


@query("greedy_match", f"""WITH RECURSIVE v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n DESC, name DESC, code DESC) AS r, total FROM (SELECT *, sum(n) OVER (PARTITION BY name) AS total FROM {_VOTES}) WHERE total >= 10),
w AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS names, []::VARCHAR[] AS codes UNION ALL SELECT v.r, CASE WHEN ok THEN list_append(names, name) ELSE names END, CASE WHEN ok THEN list_append(codes, code) ELSE codes END
 FROM (SELECT v.*, w.names, w.codes, NOT list_contains(w.names, v.name) AND NOT list_contains(w.codes, v.code) AS ok FROM w JOIN v ON v.r = w.r + 1) v)
SELECT v.name, v.code, v.n, v.n / v.total < 0.5 OR v.n < 5 AS low FROM v JOIN w ON w.r = v.r JOIN w AS before ON before.r = v.r - 1 WHERE len(w.names) > len(before.names)""")
def greedy_match(spark, sf):
    return N.greedy_pairs(_votes(spark, sf))


@query("mode_min_tie", "SELECT o_custkey, min(m) AS mode FROM (SELECT o_custkey, o_orderpriority AS m, rank() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC) AS r FROM orders GROUP BY 1, 2) WHERE r = 1 GROUP BY 1")
def mode_min_tie(spark, sf):
    return N.mode_least(read(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


@query("value_counts_top", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 30")
def value_counts_top(spark, sf):
    """The thirty most frequent codes: a top-k report."""
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(30)


@query("topk_sorted", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50")
def topk_sorted(spark, sf):
    """The fifty worst cases in mixed order: a top-k report."""
    l = read(spark, sf, "lineitem")
    return l.orderBy(F.when(F.col("l_returnflag") == "R", 0).otherwise(1), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(50).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("issues_rollup", f"""SELECT coalesce(legal, 'all') AS legal, count(*) AS n_lots, count(*) FILTER (match <> 'none') AS n_drawn, count(*) FILTER (n_cand > 1) AS n_conflict, count(*) FILTER (match = 'none') AS n_unassigned FROM {ASSIGNED} GROUP BY ROLLUP (legal)""")
def issues_rollup(spark, sf):
    a = assigned(spark, sf).rollup("legal").agg(F.count("*").alias("n_lots"), F.count_if(F.col("match") != "none").alias("n_drawn"), F.count_if(F.col("n_cand") > 1).alias("n_conflict"), F.count_if(F.col("match") == "none").alias("n_unassigned"))
    return a.withColumn("legal", F.coalesce("legal", F.lit("all")))


@query("location_waterfall", f"""WITH l AS MATERIALIZED {LEDGER}, u AS (SELECT DISTINCT tong * 10 + ban AS unit FROM l), o AS (SELECT tong * 10 + ban AS unit, min(lot) AS lot FROM l WHERE apt AND ban = 3 GROUP BY 1),
f AS (SELECT tong * 10 + ban AS unit, arg_min(legal, seq) AS legal, arg_min(lot, seq) AS lot FROM l WHERE ban <> 5 GROUP BY 1), c AS (SELECT tong * 10 + ban AS unit, max(legal) AS legal FROM l GROUP BY 1)
SELECT u.unit, CASE WHEN o.unit IS NOT NULL THEN 'o' WHEN f.unit IS NOT NULL THEN f.legal ELSE c.legal END AS legal, CASE WHEN o.unit IS NOT NULL THEN o.lot WHEN f.unit IS NOT NULL THEN f.lot ELSE '' END AS lot, CASE WHEN o.unit IS NOT NULL THEN 0 WHEN f.unit IS NOT NULL THEN 1 ELSE 2 END AS source
 FROM u LEFT JOIN o ON o.unit = u.unit LEFT JOIN f ON f.unit = u.unit LEFT JOIN c ON c.unit = u.unit""")
def location_waterfall(spark, sf):
    l = ledger(spark, sf).withColumn("unit", F.col("tong") * 10 + F.col("ban"))
    override = l.where("apt and ban = 3").groupBy("unit").agg(F.lit("o").alias("legal"), F.min("lot").alias("lot"))
    first = l.where("ban <> 5").groupBy("unit").agg(F.min_by("legal", "seq").alias("legal"), F.min_by("lot", "seq").alias("lot"))
    centre = l.groupBy("unit").agg(F.max("legal").alias("legal"), F.lit("").alias("lot"))
    return N.waterfall(l.select("unit").distinct(), override, first, centre, key="unit")


@query("audit_review", f"""SELECT legal, lot, tong, CASE WHEN regexp_matches(lot, '^[0-9]+-[0-9]{{3,}}$') AND CAST(split_part(lot, '-', 2) AS BIGINT) > CAST(split_part(lot, '-', 1) AS BIGINT) THEN 'artifact' WHEN CAST(regexp_extract(lot, '[0-9]+', 0) AS INT) % 3 = 0 THEN 'site' ELSE 'other' END AS category,
 row_number() OVER (PARTITION BY legal ORDER BY CASE WHEN regexp_matches(lot, '^[0-9]+-[0-9]{{3,}}$') AND CAST(split_part(lot, '-', 2) AS BIGINT) > CAST(split_part(lot, '-', 1) AS BIGINT) THEN 2 WHEN CAST(regexp_extract(lot, '[0-9]+', 0) AS INT) % 3 = 0 THEN 0 ELSE 1 END, lot, tong, seq) AS priority
 FROM (SELECT legal, CASE WHEN ban = 4 THEN lot || '99' ELSE lot END AS lot, tong, seq FROM {LEDGER})""")
def audit_review(spark, sf):
    l = ledger(spark, sf).withColumn("lot", F.when(F.col("ban") == 4, F.concat("lot", F.lit("99"))).otherwise(F.col("lot")))
    artifact = lots.range_artifact(F.col("lot"))
    category = F.when(artifact, "artifact").when(F.regexp_extract("lot", r"\d+", 0).cast("int") % 3 == 0, "site").otherwise("other")
    rank = F.when(category == "artifact", 2).when(category == "site", 0).otherwise(1)
    reviewed = l.select("legal", "lot", "tong", "seq", category.alias("category"), rank.alias("rank"))
    return numbered(reviewed, "legal", ["rank", "lot", "tong", "seq"], "priority").select("legal", "lot", "tong", "category", "priority")


@query("repro_diff", f"""WITH a AS (SELECT DISTINCT legal, lot, tong FROM {ASSIGNED} WHERE match <> 'none'), b AS (SELECT DISTINCT legal, lot, tong FROM {ASSIGNED} WHERE match = 'exact')
SELECT 'new' AS side, legal, lot, tong FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'golden', legal, lot, tong FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def repro_diff(spark, sf):
    a = assigned(spark, sf).where("match <> 'none'").select("legal", "lot", "tong").distinct()
    b = assigned(spark, sf).where("match = 'exact'").select("legal", "lot", "tong").distinct()
    return a.exceptAll(b).select(F.lit("new").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("golden").alias("side"), "*"))


@query("parser_ab", f"""WITH p AS (SELECT DISTINCT legal, lot FROM {PARCEL}), new AS (SELECT DISTINCT legal, regexp_replace(lot, '-0$', '') AS lot FROM {LEDGER}), old AS (SELECT DISTINCT legal, lot FROM {LEDGER} WHERE NOT lot LIKE '산%')
SELECT legal, count(*) FILTER (n AND p) AS new_on_map, count(*) FILTER (o AND p) AS old_on_map, count(*) FILTER (n AND p AND NOT o) AS recovered FROM (SELECT legal, lot, bool_or(s = 'n') AS n, bool_or(s = 'o') AS o, bool_or(s = 'p') AS p FROM
 (SELECT *, 'n' AS s FROM new UNION ALL SELECT *, 'o' FROM old UNION ALL SELECT *, 'p' FROM p) GROUP BY 1, 2) GROUP BY 1""")
def parser_ab(spark, sf):
    """How many lots on the map two readings of the ledger find, and which only the new one does."""
    l = ledger(spark, sf)
    side = lambda df, s: df.select("legal", "lot", F.lit(s).alias("s"))
    both = side(l.withColumn("lot", lots.without_zero_sub(F.col("lot"))), "n").unionByName(side(l.where(~F.col("lot").startswith("산")), "o")).unionByName(side(parcels(spark, sf), "p"))
    seen = both.groupBy("legal", "lot").agg(*[F.max(F.col("s") == k).alias(k) for k in "nop"])
    return seen.groupBy("legal").agg(F.count_if(F.col("n") & F.col("p")).alias("new_on_map"), F.count_if(F.col("o") & F.col("p")).alias("old_on_map"), F.count_if(F.col("n") & F.col("p") & ~F.col("o")).alias("recovered"))


@query("circular_distance", "SELECT n_nationkey AS a, r_regionkey AS b, least(abs(n_nationkey - r_regionkey) % 12, 12 - abs(n_nationkey - r_regionkey) % 12) AS distance FROM nation JOIN region ON r_regionkey = n_regionkey")
def circular_distance(spark, sf):
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").alias("a"), F.col("r_regionkey").alias("b"), lots.circular_distance(F.col("n_nationkey"), F.col("r_regionkey")).alias("distance"))


@query("fragment_grades", "SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) * 5 <= 10 THEN '지번오류의심' WHEN count(*) * 5 <= 60 THEN '블록분리' ELSE '과대확장의심' END AS grade FROM lineitem GROUP BY 1")
def fragment_grades(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).withColumn("grade", lots.grade(F.col("n") * 5))


_LOT = "([가-힣]{2,4}[동리])\\s*(산?[0-9]+(?:-[0-9]+)?)"


@query("first_lot", f"SELECT id, CASE WHEN l IN ('가람동', '나래동') THEN l ELSE '' END AS legal, CASE WHEN l IN ('가람동', '나래동') THEN lot ELSE '' END AS lot FROM (SELECT p_partkey AS id, regexp_extract(s, '{_LOT}', 1) AS l, regexp_extract(s, '{_LOT}', 2) AS lot FROM (SELECT p_partkey, {_AREA} AS s FROM part))")
def first_lot(spark, sf):
    t = read(spark, sf, "part").selectExpr("p_partkey AS id", f"{_AREA} AS s").withColumn("x", lots.first_lot(F.col("s"), ["가람동", "나래동"]))
    return t.select("id", F.coalesce("x.legal", F.lit("")).alias("legal"), F.coalesce("x.lot", F.lit("")).alias("lot"))


@query("cluster_name", f"""SELECT p_partkey AS id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[()（）]', ' ', 'g'), '^[가-힣]{{2,4}}[동리]\\s*', ''), '[0-9]+동.*$', ''), '[0-9]+호.*$', ''), '산?[0-9][0-9~ㆍ-]*', '', 'g'), '상가|아파트|유치원|,', '', 'g')), '[\\s·~（）]|시흥장현|차$', '', 'g') AS name FROM (SELECT p_partkey, {_AREA} AS s FROM part)""")
def cluster_name(spark, sf):
    t = read(spark, sf, "part").selectExpr("p_partkey AS id", f"{_AREA} AS s")
    return t.select("id", lots.cluster_name(F.col("s")).alias("name"))


@query("nice_number", "SELECT o_orderkey AS id, CAST(arg_min(v, abs(v - o_totalprice / 50) + v * 1e-12) AS INT) AS nice FROM orders, (SELECT unnest([50, 100, 200, 300, 500, 1000, 2000, 3000, 5000]) AS v) GROUP BY 1")
def nice_number(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), lots.nice_number(F.col("o_totalprice") / 50).alias("nice"))


#: Confirmed lots of complexes: one a supplier.
_CONFIRMED = "CAST(s_suppkey % 20 AS STRING) AS code, 'Brand#' || CAST(1 + s_suppkey % 5 AS STRING) || CAST(1 + s_suppkey % 7 AS STRING) || ' 아파트' AS apt_name, ' ' || CAST(s_suppkey AS STRING) || '-3 ' AS lot"


@query("known_lots", f"""WITH t AS (SELECT CAST(p_partkey % 20 AS VARCHAR) AS code, {_AREA} AS s, p_brand FROM part), h AS (SELECT code, CASE WHEN strpos(s, ' A동') > 0 THEN s[:strpos(s, ' A동')] END AS h, p_brand FROM t),
e AS (SELECT code, lower(p_brand) AS name, regexp_extract(h, '{_LOT}', 2) AS lot FROM h WHERE h IS NOT NULL UNION ALL SELECT code, lower(replace(apt_name, ' 아파트', '')), trim(lot) FROM (SELECT {_CONFIRMED} FROM supplier))
SELECT code, name, array_to_string(list_sort(list(DISTINCT lot)), ',') AS lots FROM e GROUP BY 1, 2""")
def known_lots(spark, sf):
    t = read(spark, sf, "part").selectExpr("CAST(p_partkey % 20 AS STRING) AS code", f"{_AREA} AS area")
    confirmed = read(spark, sf, "supplier").selectExpr(*_CONFIRMED.split(", "))
    return N.known_lots(t, confirmed, ["가람동", "나래동"]).select("code", "name", F.array_join("lots", ",").alias("lots"))


@query("lookup", f"""WITH i AS MATERIALIZED (SELECT legal, lot, min(tong) AS tong FROM {LEDGER} GROUP BY 1, 2), a AS (SELECT DISTINCT legal, regexp_replace(lot, '^산', '') AS lot FROM {PARCEL})
SELECT a.legal, a.lot, coalesce(e.tong, CASE WHEN e.lot IS NULL THEN m.tong END) AS tong FROM a LEFT JOIN i e ON e.legal = a.legal AND e.lot = a.lot LEFT JOIN i m ON m.legal = a.legal AND m.lot = '산' || a.lot""")
def lookup(spark, sf):
    index = ledger(spark, sf).groupBy("legal", "lot").agg(F.min("tong").alias("tong"))
    asked = parcels(spark, sf).select("legal", F.regexp_replace("lot", "^산", "").alias("lot")).distinct()
    return N.lookup(index, asked)


@query("review_report", f"""WITH l AS MATERIALIZED {LEDGER}, a AS (SELECT '미표시' AS kind, tong % 3 AS dong, tong, NULL::BIGINT AS n, NULL::BIGINT AS d, 'r' AS detail FROM (SELECT DISTINCT tong FROM l)),
f AS (SELECT tong % 3 AS dong, tong, count(*) * 3 AS n, sum(ban) AS d, array_to_string(list_sort(list(DISTINCT lot))[:15], ' / ') AS detail FROM l WHERE apt GROUP BY tong, legal),
b AS (SELECT '분리/' || CASE WHEN n <= 10 THEN '지번오류의심' WHEN n <= 60 THEN '블록분리' ELSE '과대확장의심' END AS kind, dong, tong, n, CAST(d AS BIGINT) AS d, detail FROM f),
c AS (SELECT '누락' AS kind, tong % 3 AS dong, tong, count(*) AS n, NULL::BIGINT AS d, array_to_string(list_sort(list(lot))[:15], ' / ') AS detail FROM l GROUP BY 2, 3) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def review_report(spark, sf):
    l = ledger(spark, sf).withColumn("dong", F.col("tong") % 3)
    fragments = l.where("apt").groupBy("dong", "tong", "legal").agg((F.count("*") * 3).alias("n"), F.sum("ban").alias("d"))
    key = ["dong", "tong", "legal"]
    fragments = fragments.join(top_lots(l.where("apt").select(*key, "lot").distinct(), key, 15, "lots"), key)
    return N.review_rows(l.select("dong", "tong").distinct().withColumn("reason", F.lit("r")), fragments, l.select("dong", "tong", "lot"))
