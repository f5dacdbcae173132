"""Complexes, aliases, votes and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotweave.functions import lots
from lotweave.operators.assign import top_lots

# Tokens that end a complex's name; names that aren't homes; where a building's note ends.
LOT_LIKE = r"^(산?\d[\d\-～~ㆍ·,]*(외)?|\d+필지|외)$"
NON_HOME = r"유치원|초등학교|중학교|고등학교|어린이집|주민센터|행정복지|상사|산업|교회|성당|병원|의원|시장|주유소|센터$|상가$"
UNIT_NOTE = r"(\d+)\s*동\s*([^,，()]*?)(?=(?:\d+\s*동)|[,，()]|$)"


def complex_name(head: Column, districts: list[str]) -> Column:
    """A complex's name from the text before its first building: the last words, up to a district or a lot."""
    clean = F.regexp_replace(F.replace(head, F.lit("Ⓐ"), F.lit(" ")), r"[()（）\[\],，]", " ")
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    stops = F.transform(words, lambda w: w.isin(districts) | w.rlike(LOT_LIKE))
    last = F.size(words) - F.array_position(F.reverse(stops), F.lit(True)).cast("int") + 1
    own = F.when(F.array_contains(stops, True), F.slice(words, last + 1, F.size(words))).otherwise(words)
    edge = F.lit(" ·～~-")
    name = F.regexp_replace(F.btrim(F.array_join(own, " "), edge), r"^산?\d[\d\-～~ㆍ·]*(?:외)?\s*(?:\d+\s*필지)?\s*(?:번지)?\s*", "")
    return F.when(F.size(words) > 0, F.btrim(name, edge)).otherwise("")


def apartment_index(rows: DataFrame, districts: list[str], text: str = "area") -> DataFrame:
    """(code, tong, ban, apt, name, building, note) of each building named in a row; rows: (code, tong, ban, row_no, text).

    Rows that only say which units the rest has are left out. Repeated entries stay once.
    """
    t = F.col(text)
    rest = t.contains("제외") & t.rlike(r"\d+\s*통")
    edge = r"(?:^|[\s(（])"
    first = F.least(*[F.nullif(F.coalesce(F.regexp_instr(t, F.lit(p)), F.lit(0)), F.lit(0)) for p in (r"\d+\s*동", edge + f"[{lots.BUILDING_LETTERS}]동", edge + "[A-Za-z]동")])
    out = rows.where(~rest).withColumn("_at", first).where("_at is not null").withColumn("apt", complex_name(F.substring(t, F.lit(1), F.col("_at") - 1), districts)).where("apt <> ''")
    notes = F.zip_with(F.regexp_extract_all(t, F.lit(UNIT_NOTE), F.lit(1)), F.regexp_extract_all(t, F.lit(UNIT_NOTE), F.lit(2)), lambda a, b: F.struct(a.alias("b"), F.btrim(b, F.lit(" ·~-")).alias("n")))
    out = out.withColumn("_notes", notes).withColumn("building", F.explode(lots.buildings(t)))
    own = F.filter("_notes", lambda x: x["b"] == F.col("building"))
    # The last note of a building counts.
    out = out.withColumn("note", F.coalesce(F.get(own, F.size(own) - 1)["n"], F.lit(""))).withColumn("name", lots.search_name(F.col("apt")))
    w = Window.partitionBy("code", "name", "building", "tong", "ban", "note").orderBy("row_no")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("code", "tong", "ban", "apt", "name", "building", "note")


def match_aliases(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, aliases, basis, status): which official names stand for a ledger name. names: (id, name, lots array); candidates: (id, n, official, lot).

    In this order: names whose lot is the complex's; one longer or shorter form of the name; several of them (to be checked); the
    same name; no candidate; the most similar one (to be checked).
    """
    own = lots.search_name(F.col("name"))
    met = names.select("id", "name", own.alias("key"), "lots").join(candidates, "id", "left").withColumn("form", lots.search_name(F.col("official")))
    met = met.withColumn("hit", F.coalesce(F.col("lot") != "", F.lit(False)) & F.coalesce(F.array_contains("lots", F.col("lot")), F.lit(False)))
    met = met.withColumn("good", (F.col("form") != "") & (F.col("hit") | ~F.col("official").rlike(NON_HOME) | F.col("name").rlike(NON_HOME)))
    good = F.col("good")
    entry = F.struct("n", "form", "official")
    gathered = met.groupBy("id").agg(
        F.collect_list(F.when(good & F.col("hit") & (F.col("form") != F.col("key")), entry)).alias("by_lot"),
        F.collect_list(F.when(good & lots.contains_either_way(F.col("key"), F.col("form")), entry)).alias("by_name"),
        F.max(F.coalesce(good & (F.col("form") == F.col("key")), F.lit(False))).alias("same"),
        F.max(F.coalesce(good, F.lit(False))).alias("some"),
        F.max_by(entry, F.when(good, F.struct(lots.bigram_similarity(F.col("key"), F.col("form")), -F.col("n")))).alias("similar"),
    )
    def distinct(c):  # by form, the first of each
        s = F.array_sort(c)
        return F.filter(s, lambda x: ~F.exists(F.filter(s, lambda y: y["n"] < x["n"]), lambda y: y["form"] == x["form"]))

    gathered = gathered.withColumn("by_lot", distinct(F.col("by_lot"))).withColumn("by_name", distinct(F.col("by_name")))
    n_lot, n_name = F.size("by_lot"), F.size("by_name")
    official = lambda c: F.transform(c, lambda x: x["official"])
    none = F.array().cast("array<string>")
    case = lambda a, b, c, d, e, f: F.when(n_lot > 0, a).when(n_name == 1, b).when(n_name > 1, c).when(F.col("same"), d).when(~F.col("some"), e).otherwise(f)
    aliases = case(official(F.col("by_lot")), official(F.col("by_name")), official(F.col("by_name")), none, none, F.array("similar.official"))
    return gathered.select("id", aliases.alias("aliases"), case(*map(F.lit, ("지번일치", "이름확장(단일후보)", "이름확장(다수후보)", "", "", "유사후보"))).alias("basis"), case(*map(F.lit, "OOX-XX")).alias("status"))


def votes(lots_said: DataFrame, parcels: DataFrame, group: str = "dong") -> DataFrame:
    """(name, code, n): how often a name's lots are a parcel of just one district code within the group."""
    single = parcels.groupBy(group, "lot").agg(F.min("code").alias("code"), F.max("code").alias("_most")).where("code = _most").drop("_most")
    return lots_said.join(single, [group, "lot"]).groupBy("name", "code").agg(F.count("*").alias("n"))


def greedy_pairs(scored: DataFrame, least_total: int = 10) -> DataFrame:
    """(name, code, n, low): one code a name and one name a code, most votes first, ties by name and code from the last.

    Rounds instead of a global sequence: in each, the pairs that come first for both their name and their code are taken, which
    are the same ones that a walk down the sorted list takes. low: under half of the name's votes, or under 5.
    """
    from lotweave.operators.tables import written

    total = scored.groupBy("name").agg(F.sum("n").alias("total"))
    left = written(scored.join(total.where(F.col("total") >= least_total), "name"))
    taken = None
    while left.limit(1).count():
        order = F.struct("n", "name", "code")
        best_name = F.max(order).over(Window.partitionBy("name"))
        best_code = F.max(order).over(Window.partitionBy("code"))
        now = written(left.withColumn("_a", best_name).withColumn("_b", best_code).where((F.col("_a") == order) & (F.col("_b") == order)).drop("_a", "_b"))
        taken = now if taken is None else taken.unionByName(now)
        left = written(left.join(now.select("name"), "name", "left_anti").join(now.select("code"), "code", "left_anti"))
    if taken is None:
        taken = left
    return taken.select("name", "code", "n", ((F.col("n") / F.col("total") < 0.5) | (F.col("n") < 5)).alias("low"))


def mode_least(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the least one on ties."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("mode"))


def merge_review(old: DataFrame, review: DataFrame, key: list[str]) -> DataFrame:
    """old with the accepted rows of a review (status O, or a manual value, which wins) that it doesn't have yet, once each.

    review: (key, value, manual, status, seq).
    """
    manual = F.coalesce(F.trim("manual"), F.lit(""))
    chosen = review.where((F.upper(F.trim("status")) == "O") | (manual != "")).withColumn("value", F.when(manual != "", manual).otherwise(F.col("value"))).where("value <> ''")
    w = Window.partitionBy(*key, "value").orderBy("seq")
    new = chosen.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*key, "value")
    return old.select(*key, "value").unionByName(new.join(old, [*key, "value"], "left_anti"))


def waterfall(units: DataFrame, *sources: DataFrame, key: str = "tong") -> DataFrame:
    """units with (legal, lot, source): from the first of several (key, legal, lot) tables that knows the unit."""
    out = units
    for k, s in enumerate(sources):
        out = out.join(s.select(key, F.struct("legal", "lot", F.lit(k).alias("source")).alias(f"_{k}")), key, "left")
    return out.withColumn("_w", F.coalesce(*[f"_{k}" for k in range(len(sources))])).select(*units.columns, "_w.legal", "_w.lot", "_w.source")


def known_lots(rows: DataFrame, overrides: DataFrame, districts: list[str], text: str = "area") -> DataFrame:
    """(code, name, lots): lots that the ledger's rows with buildings, or confirmed entries, give for a complex.

    rows: (code, text); overrides: (code, apt_name, lot).
    """
    t = F.col(text)
    edge = r"(?:^|[\s(（])"
    first = F.least(*[F.nullif(F.coalesce(F.regexp_instr(t, F.lit(p)), F.lit(0)), F.lit(0)) for p in (r"\d+\s*동", edge + f"[{lots.BUILDING_LETTERS}]동", edge + "[A-Za-z]동")])
    head = F.substring(t, F.lit(1), first - 1)
    said = rows.select("code", head.alias("_h")).where("_h is not null").withColumn("name", lots.search_name(complex_name(F.col("_h"), districts))).where("name <> ''")
    said = said.select("code", "name", F.explode(lots.all_lots(F.col("_h"), districts)).alias("x")).select("code", "name", "x.lot")
    every = said.unionByName(overrides.select("code", lots.search_name(F.col("apt_name")).alias("name"), F.trim("lot").alias("lot")))
    return every.groupBy("code", "name").agg(F.array_sort(F.collect_set("lot")).alias("lots"))


def lookup(index: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (legal, lot) with what the index has for the lot, or for the same lot with a 산 before it."""
    exact = asked.join(index, ["legal", "lot"], "left_semi").withColumn("found", F.col("lot"))
    rest = asked.join(exact.select("legal", "lot"), ["legal", "lot"], "left_anti").withColumn("found", F.concat(F.lit(lots.MOUNTAIN), F.col("lot")))
    values = [c for c in index.columns if c not in ("legal", "lot")]
    return exact.unionByName(rest).join(index.withColumnRenamed("lot", "found"), ["legal", "found"], "left").select("legal", "lot", *values)


def review_rows(missing: DataFrame, fragments: DataFrame, omissions: DataFrame) -> DataFrame:
    """(kind, dong, tong, n, d, detail) of all findings, with their place in the report: missing units, omitted lots, then fragments from the farthest."""
    none = lambda t: F.lit(None).cast(t)
    a = missing.select(F.lit("미표시").alias("kind"), "dong", "tong", none("bigint").alias("n"), none("bigint").alias("d"), F.col("reason").alias("detail"))
    b = fragments.select(F.concat(F.lit("분리/"), lots.grade(F.col("n"))).alias("kind"), "dong", "tong", "n", F.bround("d").cast("bigint").alias("d"), F.array_join(F.slice("lots", 1, 15), " / ").alias("detail"))
    key = ["dong", "tong"]
    c = omissions.groupBy(*key).agg(F.count("*").alias("n")).join(top_lots(omissions, key, 15, "lots"), key).withColumn("detail", F.array_join("lots", " / "))
    c = c.select(F.lit("누락").alias("kind"), "dong", "tong", "n", none("bigint").alias("d"), "detail")
    return a.unionByName(b).unionByName(c)


def review_order() -> list[Column]:
    kind = F.col("kind")
    return [F.when(kind == "미표시", 0).when(kind == "누락", 1).otherwise(3), F.desc(F.coalesce("d", F.lit(0))), F.col("dong"), F.col("tong")]
