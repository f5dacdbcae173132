"""Queries over lots, ledgers and assignments, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.functions import lots
from lotweave.operators import assign as A
from lotweave.operators import ledger as L
from lotweave.operators.tables import written
from lotweave.plans.proxy import ORDER, frame, read, sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def parcels(spark, sf) -> DataFrame:
    p = frame(spark, sf, "parcel")
    return p.select("id", lots.pnu_district(F.col("pnu")).alias("legal"), lots.pnu_lot(F.col("pnu")).alias("lot"))


def ledger(spark, sf) -> DataFrame:
    return frame(spark, sf, "ledger").withColumn("seq", F.struct(*ORDER)).drop(*ORDER)


PARCEL = f"""(SELECT id, substr(pnu, 1, 10) AS legal, CASE WHEN substr(pnu, 11, 1) = '2' THEN '산' ELSE '' END || CAST(CAST(substr(pnu, 12, 4) AS INT) AS VARCHAR)
 || CASE WHEN CAST(substr(pnu, 16, 4) AS INT) > 0 THEN '-' || CAST(CAST(substr(pnu, 16, 4) AS INT) AS VARCHAR) ELSE '' END AS lot FROM {sql("parcel")})"""
LEDGER = f"(SELECT tong, ban, legal, lot, apt, row_number() OVER (ORDER BY {', '.join(ORDER)}) AS seq FROM {sql('ledger')})"
#: Assignment in SQL: lists of candidates by window functions instead of two aggregations.
ASSIGNED = f"""(WITH parcel AS {PARCEL}, ledger AS MATERIALIZED {LEDGER},
 c AS (SELECT *, regexp_replace(lot, '-0$', '') AS k FROM ledger),
 pool AS (SELECT *, bool_or(apt) OVER (PARTITION BY legal, k) AS some_apt FROM c),
 pick AS (SELECT legal, k, min(tong) AS tong FROM pool WHERE apt OR NOT some_apt GROUP BY 1, 2),
 cand AS (SELECT legal, k, count(DISTINCT tong) AS n_cand FROM c GROUP BY 1, 2),
 exact AS (SELECT DISTINCT p.legal, p.k, p.tong, first_value(c.ban) OVER w AS ban, first_value(c.apt) OVER w AS apt, n_cand FROM pick p JOIN c ON c.legal = p.legal AND c.k = p.k AND c.tong = p.tong
  JOIN cand ON cand.legal = p.legal AND cand.k = p.k WINDOW w AS (PARTITION BY p.legal, p.k ORDER BY c.seq)),
 bare AS (SELECT * FROM ledger WHERE NOT apt AND strpos(lot, '-') = 0),
 main AS (SELECT legal, lot AS bon, min(tong) AS tong, arg_min(ban, seq) AS ban FROM bare GROUP BY 1, 2 HAVING count(DISTINCT tong) = 1)
 SELECT id, parcel.legal, parcel.lot, CASE WHEN exact.k IS NOT NULL THEN exact.tong ELSE main.tong END AS tong, CASE WHEN exact.k IS NOT NULL THEN exact.ban ELSE main.ban END AS ban,
 coalesce(exact.apt, false) AS apt, CAST(CASE WHEN exact.k IS NOT NULL THEN n_cand WHEN main.bon IS NOT NULL THEN 1 ELSE 0 END AS INT) AS n_cand,
 CASE WHEN exact.k IS NOT NULL THEN 'exact' WHEN main.bon IS NOT NULL THEN 'bonbun' ELSE 'none' END AS match
 FROM parcel LEFT JOIN exact ON exact.legal = parcel.legal AND exact.k = parcel.lot LEFT JOIN main ON main.legal = parcel.legal AND main.bon = split_part(parcel.lot, '-', 1))"""


def assigned(spark, sf) -> DataFrame:
    return A.assign(parcels(spark, sf), ledger(spark, sf))


@query("assign_fallback", f"SELECT * FROM {ASSIGNED}")
def assign_fallback(spark, sf):
    return assigned(spark, sf)


@query("exact_assign", f"SELECT id, legal, lot, CASE WHEN match = 'exact' THEN tong END AS tong, CASE WHEN match = 'exact' THEN ban END AS ban, CASE WHEN match = 'exact' THEN n_cand ELSE 0 END AS n_cand FROM {ASSIGNED}")
def exact_assign(spark, sf):
    return A.assign(parcels(spark, sf), ledger(spark, sf), fallback=False).select("id", "legal", "lot", "tong", "ban", "n_cand")


@query("exact_assign_first", f"""WITH p AS {PARCEL}, c AS (SELECT *, regexp_replace(lot, '-0$', '') AS k FROM {LEDGER}), f AS (SELECT *, row_number() OVER (PARTITION BY legal, k ORDER BY NOT apt, seq) AS r FROM c)
SELECT p.id, f.tong FROM p LEFT JOIN f ON f.legal = p.legal AND f.k = p.lot AND f.r = 1""")
def exact_assign_first(spark, sf):
    return A.assign(parcels(spark, sf), ledger(spark, sf), policy="first", fallback=False).select("id", "tong")


@query("conflicts", f"SELECT legal, lot, tong FROM {ASSIGNED} WHERE n_cand > 1")
def conflicts(spark, sf):
    return A.conflicts(assigned(spark, sf))


@query("unassigned", f"SELECT legal, lot FROM {ASSIGNED} WHERE tong IS NULL")
def unassigned(spark, sf):
    return A.unassigned(assigned(spark, sf))


@query("table_not_in_map", f"SELECT DISTINCT tong, ban, legal, lot FROM {LEDGER} l WHERE NOT EXISTS (SELECT 1 FROM {PARCEL} p WHERE p.legal = l.legal AND p.lot = l.lot)")
def table_not_in_map(spark, sf):
    return A.not_on_map(ledger(spark, sf), parcels(spark, sf))


@query("match_summary", f"""SELECT legal, count(*) FILTER (match = 'exact') AS n_exact, count(*) FILTER (match = 'bonbun') AS n_bonbun, count(*) FILTER (match = 'none') AS n_none,
 round(100.0 * CAST(count(*) FILTER (match <> 'none') AS DOUBLE) / count(*), 4) AS matched_pct FROM {ASSIGNED} GROUP BY legal""")
def match_summary(spark, sf):
    return A.match_summary(assigned(spark, sf))


#: Units are made so small here that some have no parcel.
_SMALL = "tong * 1000 + CAST(substr(legal, 10, 1) AS INT) * 100 + ban * 10 + length(lot) % 10"


@query("missing_units", f"""WITH led AS (SELECT CAST({_SMALL} AS INT) AS tong, legal, lot FROM {LEDGER}), a AS (SELECT legal, lot, CAST({_SMALL} AS INT) AS tong FROM {ASSIGNED}),
apt AS (SELECT DISTINCT CAST({_SMALL} AS INT) AS tong FROM {LEDGER} WHERE apt AND ban = 7),
u AS (SELECT tong, bool_or(EXISTS (SELECT 1 FROM a WHERE a.legal = led.legal AND a.lot = led.lot)) AS on_map FROM led WHERE tong NOT IN (SELECT tong FROM a WHERE tong IS NOT NULL) GROUP BY tong)
SELECT tong, CASE WHEN tong IN (SELECT tong FROM apt) THEN '아파트' ELSE '일반' END AS kind,
 CASE WHEN on_map THEN '지번은 지적도에 있으나 충돌(min_tong)로 다른 통에 흡수' WHEN tong IN (SELECT tong FROM apt) THEN '표에 지번 없음/지적도에 없음(아파트 단지명 등)' ELSE '지적도에 해당 지번 없음' END AS reason FROM u""")
def missing_units(spark, sf):
    small = F.expr(f"CAST({_SMALL} AS INT)")
    a = written(assigned(spark, sf).select("legal", "lot", "tong", "ban"))  # read several times below
    led = ledger(spark, sf).withColumn("tong", small)
    return A.missing_units(led, a.withColumn("tong", small), led.where("apt and ban = 7"))


@query("spec_expand", None)
def spec_expand(spark, sf):
    s = frame(spark, sf, "spec")
    found = F.coalesce(lots.expand_spec(F.col("core"), F.col("mountain")), F.array().cast("array<string>"))
    once = F.get(F.transform(F.array(found), lambda l: F.struct(F.concat_ws(",", l).alias("lots"), F.size(l).alias("n_lots"))), F.lit(0))
    return s.select(*ORDER, "core", once.alias("f")).select(*ORDER, "core", "f.*")


def _range(prefix: str, low: str, high: str) -> str:
    return f"list_transform(generate_series({low}, {high}), lambda n: {prefix} || CAST(n AS VARCHAR))"


def _part(p: str) -> str:
    """Lots of a part without dots, in DuckDB, from its four fields."""
    f = lambda k: f"regexp_extract({p}, '^([0-9]+)(?:-([0-9]+))?~([0-9]+)(?:-([0-9]+))?$', {k})"
    n = lambda k: f"CAST({f(k)} AS BIGINT)"
    out = f"""CASE WHEN {f(2)} <> '' AND {f(4)} = '' THEN {_range(f(1) + " || '-'", n(2), n(3))}
 WHEN {f(2)} = '' AND {f(4)} = '' THEN CASE WHEN {n(1)} > {n(3)} THEN [{f(1)} || '-' || {f(3)}] ELSE {_range("''", n(1), n(3))} END
 WHEN {f(2)} = '' THEN list_concat({_range("''", n(1), n(3))}, [{f(3)} || '-' || {f(4)}])
 WHEN {f(1)} = {f(3)} THEN {_range(f(1) + " || '-'", n(2), n(4))}
 ELSE list_concat(list_concat(CASE WHEN {n(2)} <= 1 THEN [{f(1)}] ELSE {_range(f(1) + " || '-'", n(2), '199')} END, {_range("''", n(1) + ' + 1', n(3) + ' - 1')}), {_range(f(3) + " || '-'", '1', n(4))}) END"""
    return f"CASE WHEN strpos({p}, '~') = 0 THEN [{p}] WHEN {f(1)} <> '' THEN {out} END"


ORACLE["spec_expand"] = f"""WITH s AS {sql("spec")}, parts AS (SELECT *, unnest(list_transform(string_split(core, 'ㆍ'), lambda x: CASE WHEN strpos(core, 'ㆍ') > 0 AND strpos(x, '-') = 0 THEN split_part(core, '-', 1) || '-' || x ELSE x END)) AS p,
 generate_subscripts(string_split(core, 'ㆍ'), 1) AS i FROM s),
e AS (SELECT *, {_part("p")} AS l FROM parts),
g AS (SELECT {", ".join(ORDER)}, any_value(core) AS core, any_value(mountain) AS mountain, flatten(list(CASE WHEN len(l) <= 2000 THEN l END ORDER BY i)) AS l, bool_or(l IS NULL OR len(l) > 2000) AS bad FROM e GROUP BY {", ".join(ORDER)}),
r AS (SELECT *, CASE WHEN bad THEN [] WHEN mountain THEN list_transform(l, lambda x: '산' || x) ELSE l END AS o FROM g)
SELECT {", ".join(ORDER)}, core, coalesce(array_to_string(o, ','), '') AS lots, CAST(len(o) AS INT) AS n_lots FROM r"""


@query("spec_expand_mountain", f"""WITH w AS {sql("mountain_range")}, f AS (SELECT *, regexp_extract(replace(word, '산', ''), '^([0-9]+)(?:-([0-9]+))?~([0-9]+)(?:-([0-9]+))?$', ['a', 'sa', 'b', 'sb']) AS m FROM w),
n AS (SELECT *, CAST(m.a AS BIGINT) AS na, CAST(m.b AS BIGINT) AS nb, CAST(CASE WHEN m.sa = '' THEN '0' ELSE m.sa END AS BIGINT) AS ns, CAST(CASE WHEN m.sb = '' THEN '0' ELSE m.sb END AS BIGINT) AS ne FROM f),
o AS (SELECT *, CASE WHEN na = nb THEN list_transform(generate_series(ns, ne), lambda k: '산' || CAST(na AS VARCHAR) || CASE WHEN k = 0 THEN '' ELSE '-' || CAST(k AS VARCHAR) END)
 WHEN nb > na AND nb - na < 2000 THEN list_concat(list_concat(list_transform(generate_series(na, nb), lambda k: '산' || CAST(k AS VARCHAR)), CASE WHEN m.sa <> '' THEN ['산' || m.a || '-' || m.sa] ELSE [] END), CASE WHEN m.sb <> '' THEN ['산' || m.b || '-' || m.sb] ELSE [] END) ELSE [] END AS l FROM n)
SELECT {", ".join(ORDER)}, word, coalesce(array_to_string(l, ','), '') AS lots FROM o""")
def spec_expand_mountain(spark, sf):
    return frame(spark, sf, "mountain_range").select(*ORDER, "word", F.concat_ws(",", lots.expand_mountain_range(F.col("word"))).alias("lots"))


@query("pnu_canon", f"SELECT id, legal, lot FROM {PARCEL}")
def pnu_canon(spark, sf):
    return parcels(spark, sf)


#: Free texts with lots: an order's priority and date stand in for names around them.
_TEXT = "o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ' 산' ELSE ' ' END || CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 4 AS STRING) || CASE WHEN o_orderkey % 5 = 0 THEN ' 대' WHEN o_orderkey % 5 = 1 THEN '도' WHEN o_orderkey % 5 = 2 THEN '전 ' ELSE '' END"


@query("jibun_canon", f"""SELECT o_orderkey AS id, t, CASE WHEN strpos(t, '산') > 0 THEN '산' ELSE '' END || CAST(CAST(regexp_extract(t, '([0-9]+)(?:-([0-9]+))?', 1) AS BIGINT) AS VARCHAR)
 || CASE WHEN regexp_extract(t, '([0-9]+)(?:-([0-9]+))?', 2) IN ('', '0') THEN '' ELSE '-' || regexp_extract(t, '([0-9]+)(?:-([0-9]+))?', 2) END AS lot FROM (SELECT o_orderkey, {_TEXT} AS t FROM orders)""")
def jibun_canon(spark, sf):
    t = read(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{_TEXT} AS t")
    return t.withColumn("lot", lots.jibun_lot(F.col("t")))


@query("jimok_variants", f"""SELECT o_orderkey AS id, regexp_extract(t, '([가-힣]+) *$', 1) AS hangul, trim(regexp_extract(t, '([^0-9]*)$', 1)) AS stripped, regexp_extract(t, '([^0-9]*)$', 1) AS raw FROM (SELECT o_orderkey, {_TEXT} AS t FROM orders)""")
def jimok_variants(spark, sf):
    t = read(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{_TEXT} AS t")
    return t.select("id", *[lots.land_category(F.col("t"), m).alias(m) for m in ("hangul", "stripped", "raw")])


_NOISE = "'　가동 ' || CAST(p_partkey AS STRING) || ' ～ ' || CAST(p_partkey + 3 AS STRING) || ' · 5，7 (부번지 포함) 771(' || p_brand || ' 101호, 102호) 〜9' || p_name"


@query("normalize_text", f"""SELECT p_partkey AS id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(t, '～〜∼·，　', '~~~ㆍ, '), '\\s*~\\s*', '~', 'g'), '\\s*ㆍ\\s*', 'ㆍ', 'g'), '\\(\\s*부번지?\\s*포함\\s*\\)', ' ', 'g'), '\\([^)]*\\)', ' Ⓐ ', 'g') AS text
 FROM (SELECT p_partkey, {_NOISE} AS t FROM part)""")
def normalize_text(spark, sf):
    t = read(spark, sf, "part").selectExpr("p_partkey AS id", f"{_NOISE} AS t")
    return t.select("id", lots.mark_parentheses(lots.normalize_text(F.col("t"))).alias("text"))


#: A ledger row for each part: its lines' specs, with districts, noise and an unknown district among them.
_DISTRICTS = ["가람동", "나래동", "다솜리", "라온동"]
_SAID = """CASE WHEN l_linenumber = 1 THEN CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN '가람동 ' WHEN 1 THEN '나래동' WHEN 2 THEN '다솜리 ' WHEN 3 THEN '라온동 ' ELSE '마루동 ' END ELSE '' END
 || CASE WHEN mountain THEN '산' ELSE '' END || core || CASE CAST(l_quantity AS INT) % 6 WHEN 0 THEN '(부번지 포함)' WHEN 1 THEN '(푸른빌라 101호, 102호)' WHEN 2 THEN '번지' WHEN 3 THEN ' 하늘마을 501~903' WHEN 4 THEN ' 77' ELSE '' END"""


#: Ledger rows in SQL, and their normal form.
_AREAS = f"(SELECT l_partkey AS row_no, string_agg({_SAID}, ', ' ORDER BY {', '.join(ORDER)}) AS area FROM {sql('spec')} GROUP BY 1)"
_NORMAL = r"regexp_replace(regexp_replace(translate(area, '～〜∼·，　', '~~~ㆍ, '), '\s*~\s*', '~', 'g'), '\s*ㆍ\s*', 'ㆍ', 'g')"


def _expanded(core: str, mountain: str) -> str:
    """Lots of a spec with dots in DuckDB, null if a part can't be read or is too long."""
    parts = f"list_filter(string_split({core}, 'ㆍ'), lambda x: x <> '')"
    full = f"list_transform({parts}, lambda x: CASE WHEN strpos({core}, 'ㆍ') > 0 AND strpos({parts}[1], '-') > 0 AND strpos(x, '-') = 0 THEN split_part({parts}[1], '-', 1) || '-' || x ELSE x END)"
    each = f"list_transform({full}, lambda p: {_part('p')})"
    prefix = f"CASE WHEN {mountain} THEN '산' ELSE '' END"
    return f"CASE WHEN len(list_filter({each}, lambda l: l IS NULL OR len(l) > 2000)) = 0 THEN list_transform(flatten({each}), lambda x: {prefix} || x) END"


ORACLE["ledger_expand"] = rf"""WITH a AS (SELECT row_no, regexp_replace(regexp_replace({_NORMAL}, '\(\s*부번지?\s*포함\s*\)', ' ', 'g'), '\([^)]*\)', ' Ⓐ ', 'g') AS area FROM {_AREAS}),
b AS (SELECT row_no, unnest(string_split(area, ',')) AS s, generate_subscripts(string_split(area, ','), 1) - 1 AS seg FROM a),
c AS (SELECT row_no, seg, trim(s) AS s, regexp_extract(trim(s), '^([가-힣]{{1,4}}[동리])\s*(.*)$', 1) AS d, regexp_extract(trim(s), '^([가-힣]{{1,4}}[동리])\s*(.*)$', 2) AS rest FROM b WHERE trim(s) <> ''),
k AS (SELECT *, CASE WHEN d IN ({", ".join(f"'{x}'" for x in _DISTRICTS)}) THEN d END AS new FROM c),
g AS (SELECT row_no, seg, last_value(new IGNORE NULLS) OVER w AS legal, count(new) OVER w AS part, regexp_matches(s, '{L.APARTMENT}') AS apt, CASE WHEN new IS NULL THEN s ELSE trim(rest) END AS body FROM k WINDOW w AS (PARTITION BY row_no ORDER BY seg ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, unnest(string_split_regex(body, '\s+')) AS raw, generate_subscripts(string_split_regex(body, '\s+'), 1) AS j FROM g WHERE legal IS NOT NULL),
v AS (SELECT *, regexp_replace(trim(split_part(raw, '(', 1), ',.'), '번지$', '') AS word FROM r),
x AS (SELECT *, sum(CASE WHEN regexp_matches(word, '[가-힣]') AND NOT regexp_matches(word, '^산?[0-9][0-9~ㆍ산-]*$') THEN 1 ELSE 0 END) OVER (PARTITION BY row_no, seg ORDER BY j ROWS UNBOUNDED PRECEDING) AS over FROM v WHERE word <> ''),
y AS (SELECT *, row_number() OVER (PARTITION BY row_no, seg ORDER BY j) - 1 AS "at", word LIKE '산%' AS m, trim(CASE WHEN word LIKE '산%' THEN substr(word, 2) ELSE word END, '-~ㆍ') AS core FROM x WHERE over = 0 AND regexp_matches(word, '^산?[0-9][0-9~ㆍ-]*$')),
z AS (SELECT *, {_expanded("core", "m")} AS l FROM y),
t AS (SELECT *, CASE WHEN len(l) > 0 THEN l END AS found, CASE WHEN l IS NULL OR len(l) = 0 THEN NULL WHEN m THEN '' WHEN strpos(core, '-') > 0 THEN coalesce(CAST(try_cast(split_part(core, '-', 1) AS BIGINT) AS VARCHAR), '') END AS leaves FROM z),
u AS (SELECT *, last_value(leaves IGNORE NULLS) OVER (PARTITION BY row_no, part ORDER BY seg, "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bon FROM t),
f AS (SELECT *, CASE WHEN found IS NOT NULL THEN list_concat(found, CASE WHEN NOT m AND strpos(core, '-') = 0 AND bon <> '' THEN list_transform(found, lambda q: bon || '-' || q) ELSE [] END) END AS every FROM u),
o AS (SELECT row_no, seg, "at", generate_subscripts(every, 1) - 1 AS n, 'lot' AS kind, legal, unnest(every) AS lot, apt FROM f WHERE every IS NOT NULL
 UNION ALL SELECT row_no, seg, "at", 0, 'failed', legal, word, apt FROM f WHERE every IS NULL UNION ALL SELECT row_no, seg, NULL, 0, 'failed', '', body, apt FROM g WHERE legal IS NULL
 UNION ALL SELECT g.row_no, g.seg, CASE WHEN h.n_words > 0 THEN 0 END, 0, 'apartment', legal, body, apt FROM g LEFT JOIN (SELECT row_no, seg, count(*) AS n_words, count(every) AS n_read FROM f GROUP BY 1, 2) h ON h.row_no = g.row_no AND h.seg = g.seg WHERE legal IS NOT NULL AND body <> '' AND coalesce(h.n_read, 0) = 0)
SELECT row_no, CAST(seg AS INT) AS seg, CAST("at" AS INT) AS "at", CAST(n AS INT) AS n, kind, legal, lot, apt FROM o"""


@query("ledger_expand", ORACLE["ledger_expand"])
def ledger_expand(spark, sf):
    said = frame(spark, sf, "spec").selectExpr(*ORDER, f"{_SAID} AS w", "l_partkey AS row_no")
    rows = said.groupBy("row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "w"))), lambda x: x["w"]), ", ").alias("area"))
    return L.expand_ledger(rows, _DISTRICTS).select("row_no", "seg", "at", "n", "kind", "legal", "lot", "apt")


@query("continuation", f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) WHEN l_partkey % 7 = 1 THEN '산5' ELSE CAST(l_linenumber + 20 AS VARCHAR) END AS w FROM lineitem),
e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS i, CASE WHEN w LIKE '산%' THEN '' WHEN strpos(w, '-') > 0 THEN split_part(w, '-', 1) END AS leaves FROM s),
b AS (SELECT *, last_value(leaves IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bon FROM e)
SELECT l_orderkey AS row_no, w AS lot, count(*) AS n FROM (SELECT l_orderkey, w FROM b UNION ALL SELECT l_orderkey, bon || '-' || w FROM b WHERE bon <> '' AND strpos(w, '-') = 0 AND w NOT LIKE '산%') GROUP BY 1, 2""")
def continuation(spark, sf):
    w = "CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) WHEN l_partkey % 7 = 1 THEN '산5' ELSE CAST(l_linenumber + 20 AS STRING) END"
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("row_no")).agg(F.array_sort(F.collect_list(F.struct(*ORDER[1:], F.expr(w).alias("w")))).alias("a"))
    rows = rows.select("row_no", F.concat(F.lit("가람동 "), F.array_join(F.transform("a", lambda x: x["w"]), " ")).alias("area"))
    return L.expand_ledger(rows, _DISTRICTS).groupBy("row_no", "lot").agg(F.count("*").alias("n"))


@query("carry_forward", """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' OR value > 80 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_type FROM events""")
def carry_forward(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "ts", F.when((F.col("event_type") == "purchase") | (F.col("value") > 80), F.col("event_type")).alias("last_type"))
    return L.carry_forward(e, ["user_id"], ["ts", "event_id"], "last_type").select("event_id", "user_id", "last_type")


_PARA = "CASE WHEN l_partkey % 3 = 0 THEN '가람동 ' || CAST(l_partkey AS STRING) WHEN l_partkey % 3 = 1 THEN ' 산 ' || CAST(l_partkey AS STRING) ELSE CAST(l_partkey AS STRING) || '-1' END"


@query("group_bans", f"""WITH p AS (SELECT l_orderkey AS cell, {_PARA} AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS i FROM lineitem),
g AS (SELECT *, sum(CASE WHEN i = 1 OR t LIKE '가%' THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY i) AS block FROM p)
SELECT cell, CAST(block AS INT) AS block, string_agg(t, ' ' ORDER BY i) AS text FROM g GROUP BY 1, 2""")
def group_bans(spark, sf):
    p = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cell"), F.expr(_PARA).alias("t"), F.struct(*ORDER).alias("i"))
    return L.group_paragraphs(p, "cell", "i", "t")


_LABEL = "CASE WHEN o_orderkey % 9 = 0 THEN '1반 3반' ELSE '1반, 2반 3반' END"


@query("ban_label_check", f"SELECT o_orderkey AS id, regexp_replace(l, '[^0-9]', '', 'g') <> array_to_string(generate_series(1, o_orderkey % 4), '') AS mismatch FROM (SELECT o_orderkey, {_LABEL} AS l FROM orders)")
def ban_label_check(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), L.label_mismatch(F.expr(_LABEL), (F.col("o_orderkey") % 4).cast("int")).alias("mismatch"))


@query("address_index", f"SELECT legal || '|' || lot AS key, code, tong, ban FROM (SELECT *, tong % 4 AS code, row_number() OVER (PARTITION BY legal, lot ORDER BY tong % 4, id) AS r FROM {ASSIGNED} WHERE match <> 'none') WHERE r = 1")
def address_index(spark, sf):
    a = assigned(spark, sf).where("match <> 'none'").withColumn("code", F.col("tong") % 4)
    first = A.index_first(a, ["legal", "lot"], ["code", "id"])
    return first.select(lots.composite_key(F.col("legal"), F.col("lot")).alias("key"), "code", "tong", "ban")


@query("unassigned_index", f"SELECT legal || '|' || lot AS key, id FROM (SELECT *, row_number() OVER (PARTITION BY legal, lot ORDER BY id DESC) AS r FROM {ASSIGNED} WHERE match = 'none') WHERE r = 1")
def unassigned_index(spark, sf):
    last = A.index_first(assigned(spark, sf).where("match = 'none'"), ["legal", "lot"], ["id"], last=True)
    return last.select(lots.composite_key(F.col("legal"), F.col("lot")).alias("key"), "id")


@query("audit_status", f"""WITH led AS (SELECT *, tong % 3 AS dong FROM {LEDGER}), d AS MATERIALIZED (SELECT legal, lot, tong % 3 AS dong, CASE WHEN id % 4 = 0 THEN tong + 1 ELSE tong END AS tong FROM {ASSIGNED} WHERE tong IS NOT NULL AND ban <> 2), p AS MATERIALIZED {PARCEL},
l AS (SELECT dong, legal, lot, bool_and(apt) AS only_apt FROM led GROUP BY 1, 2, 3),
s AS (SELECT l.dong, l.legal, l.lot, CASE WHEN (l.dong, l.legal, l.lot) IN (SELECT (d.dong, d.legal, d.lot) FROM d JOIN led ON led.dong = d.dong AND led.legal = d.legal AND led.lot = d.lot AND led.tong = d.tong) THEN '정확'
 WHEN (l.dong, l.legal, l.lot) IN (SELECT (dong, legal, lot) FROM d) THEN '오배정' WHEN only_apt THEN NULL WHEN (l.legal, l.lot) IN (SELECT (legal, lot) FROM d) THEN '타동'
 WHEN (l.legal, split_part(l.lot, '-', 1)) IN (SELECT (legal, split_part(lot, '-', 1)) FROM d) THEN '본번'
 WHEN (l.legal, l.lot) IN (SELECT (legal, lot) FROM p) OR (l.legal, split_part(l.lot, '-', 1)) IN (SELECT (legal, split_part(lot, '-', 1)) FROM p) THEN '누락' ELSE '폐번' END AS status FROM l)
SELECT CAST(dong AS INT) AS dong, legal, lot, status FROM s WHERE status IS NOT NULL""")
def audit_status(spark, sf):
    """The map that is audited lacks all parcels of one ban and has a fourth in a neighbouring unit, so that all outcomes occur."""
    led = ledger(spark, sf).withColumn("dong", F.col("tong") % 3)
    drawn = assigned(spark, sf).where("tong is not null and ban <> 2").withColumn("dong", F.col("tong") % 3).withColumn("tong", F.when(F.col("id") % 4 == 0, F.col("tong") + 1).otherwise(F.col("tong")))
    return A.audit(led, written(drawn.select("dong", "legal", "lot", "tong")), parcels(spark, sf))


@query("anomaly_scan", f"""WITH a AS MATERIALIZED {ASSIGNED}, free AS (SELECT legal, split_part(lot, '-', 1) AS bon, count(*) AS n, list_sort(list(lot))[:4] AS sample FROM a WHERE tong IS NULL GROUP BY 1, 2),
taken AS (SELECT legal, split_part(lot, '-', 1) AS bon, list_sort(list(DISTINCT tong)) AS tongs FROM a WHERE tong IS NOT NULL GROUP BY 1, 2), bare AS (SELECT legal, lot AS bon, list_sort(list(DISTINCT tong)) AS bare FROM {LEDGER} WHERE NOT apt AND strpos(lot, '-') = 0 GROUP BY 1, 2)
SELECT free.legal, free.bon, n, array_to_string(sample, ',') AS sample, coalesce(array_to_string(tongs, ','), '') AS tongs, coalesce(array_to_string(bare, ','), '') AS bare
 FROM free LEFT JOIN taken ON taken.legal = free.legal AND taken.bon = free.bon LEFT JOIN bare ON bare.legal = free.legal AND bare.bon = free.bon WHERE tongs IS NOT NULL OR bare IS NOT NULL""")
def anomaly_scan(spark, sf):
    text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)
    return A.anomalies(ledger(spark, sf), written(assigned(spark, sf).select("legal", "lot", "tong"))).select("legal", "bon", "n", text("sample"), text("tongs"), text("bare"))


@query("territory_pairs", rf"""WITH b AS (SELECT row_no, unnest(string_split(area, ',')) AS s, generate_subscripts(string_split(area, ','), 1) AS seg FROM (SELECT row_no, regexp_replace({_NORMAL}, '\([^)]*\)', '', 'g') AS area FROM {_AREAS})),
c AS (SELECT row_no, seg, trim(s) AS s, regexp_matches(trim(s), '^[가-힣]{{2,4}}[동리]\s+.+$') AS named FROM b WHERE trim(s) <> ''),
d AS (SELECT row_no, seg, last_value(CASE WHEN named THEN regexp_extract(s, '^([가-힣]{{2,4}}[동리])\s+(.+)$', 1) END IGNORE NULLS) OVER (PARTITION BY row_no ORDER BY seg ROWS UNBOUNDED PRECEDING) AS legal, trim(CASE WHEN named THEN regexp_extract(s, '^([가-힣]{{2,4}}[동리])\s+(.+)$', 2) ELSE s END, ' ,') AS spec FROM c),
e AS (SELECT row_no, seg, legal, spec LIKE '산%' AS m, trim(CASE WHEN spec LIKE '산%' THEN substr(spec, 2) ELSE spec END) AS core FROM d WHERE legal IS NOT NULL),
f AS (SELECT row_no, seg, legal, CASE WHEN core = '' THEN [] ELSE {_expanded("core", "m")} END AS l FROM e),
g AS (SELECT row_no, seg, generate_subscripts(l, 1) AS i, legal, unnest(l) AS lot FROM f WHERE len(l) > 0)
SELECT row_no, CAST(row_number() OVER (PARTITION BY row_no ORDER BY seg, i) - 1 AS INT) AS at, legal, lot FROM g""")
def territory_pairs(spark, sf):
    said = frame(spark, sf, "spec").selectExpr(*ORDER, f"{_SAID} AS w", "l_partkey AS row_no")
    rows = said.groupBy("row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "w"))), lambda x: x["w"]), ", ").alias("area"))
    return rows.select("row_no", F.posexplode(lots.territory_pairs(F.col("area"))).alias("at", "p")).select("row_no", "at", "p.*")


def _n_read(oldest: bool) -> str:
    """How many lots an earlier reading finds in a spec's `parts` in DuckDB, null if it can't read one of them."""
    na, nsa, nb, nsb = (f"try_cast(regexp_extract(p, '^([0-9]+)(?:-([0-9]+))?~([0-9]+)(?:-([0-9]+))?$', {k}) AS BIGINT)" for k in (1, 2, 3, 4))
    subs = "NULL" if oldest else f"CASE WHEN {na} = {nb} THEN {nsb} - {nsa} + 1 ELSE 2 + {nb} - {na} - 1 END"
    long = "FALSE" if oldest else f"{nb} - {na} >= 2000"
    n = f"""CASE WHEN strpos(p, '~') = 0 THEN 1 WHEN {nb} IS NULL THEN NULL WHEN {nsa} IS NOT NULL AND {nsb} IS NULL THEN greatest(0, {nb} - {nsa} + 1)
 WHEN {nsa} IS NULL AND {nsb} IS NULL THEN CASE WHEN {long} THEN NULL ELSE greatest(0, {nb} - {na} + 1) END WHEN {nsa} IS NULL THEN {nb} - {na} + 2 ELSE {subs} END"""
    each = f"list_transform(parts, lambda p: {n})"
    return f"CAST(CASE WHEN len(list_filter({each}, lambda n: n IS NULL)) = 0 THEN coalesce(list_sum({each}), 0) END AS INT)"


@query("spec_readings", f"""WITH s AS (SELECT *, list_filter(string_split(core, 'ㆍ'), lambda x: x <> '') AS l FROM {sql("spec")}),
f AS (SELECT *, list_transform(l, lambda x: CASE WHEN strpos(l[1], '-') > 0 AND strpos(x, '-') = 0 THEN split_part(l[1], '-', 1) || '-' || x ELSE x END) AS parts FROM s)
SELECT {", ".join(ORDER)}, core, {_n_read(False)} AS n_older, {_n_read(True)} AS n_oldest FROM f""")
def spec_readings(spark, sf):
    """How many lots two earlier readings find in each spec."""
    return frame(spark, sf, "spec").select(*ORDER, "core", *[F.size(lots.expand_spec(F.col("core"), F.lit(False), m)).alias(f"n_{m}") for m in ("older", "oldest")])


@query("suspects_by_district", f"SELECT legal, count(*) AS n_bons, CAST(sum(n) AS BIGINT) AS n_lots FROM ({ORACLE['anomaly_scan']}) GROUP BY 1")
def suspects_by_district(spark, sf):
    return A.suspects_by_district(A.anomalies(ledger(spark, sf), written(assigned(spark, sf).select("legal", "lot", "tong"))))
