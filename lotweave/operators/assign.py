"""Assignment of parcels to units, and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotweave.functions import lots

KEY = ["legal", "lot"]


def exact_candidates(ledger: DataFrame, policy: str = "min_tong") -> DataFrame:
    """(legal, lot, tong, ban, apt, n_cand): what the ledger says of each lot; ledger: (legal, lot, tong, ban, apt, seq).

    Apartment entries win over others; of these the least unit (policy min_tong) or the first in the ledger's order. Ban and
    apt are those of the unit's first entry. Two aggregations with partial sums; no list of candidates is gathered.
    """
    entries = ledger.withColumn("lot", lots.without_zero_sub(F.col("lot")))
    units = entries.groupBy(*KEY, "tong").agg(
        F.min_by(F.struct("ban", "apt"), "seq").alias("_first"),
        F.max("apt").alias("_any"),
        F.min("seq").alias("_seq"),
        F.min(F.when(F.col("apt"), F.col("seq"))).alias("_apt_seq"),
    )
    # Of a pool of apartment entries only these count for the order.
    rank = F.struct(~F.col("_any"), F.col("tong")) if policy == "min_tong" else F.struct(~F.col("_any"), F.coalesce("_apt_seq", "_seq"))
    best = units.groupBy(*KEY).agg(F.min_by(F.struct("tong", "_first"), rank).alias("_best"), F.count("*").cast("int").alias("n_cand"))
    return best.select(*KEY, F.col("_best.tong").alias("tong"), F.col("_best._first.ban").alias("ban"), F.col("_best._first.apt").alias("apt"), "n_cand")


def main_candidates(ledger: DataFrame) -> DataFrame:
    """(legal, bon, tong, ban, apt) of main numbers that the ledger lists bare, not as an apartment, for one unit only."""
    bare = ledger.where(~F.col("apt") & ~F.col("lot").contains("-"))
    found = bare.groupBy("legal", F.col("lot").alias("bon")).agg(F.min("tong").alias("tong"), F.max("tong").alias("_most"), F.min_by(F.struct("ban", "apt"), "seq").alias("_first"))
    return found.where("tong = _most").select("legal", "bon", "tong", F.col("_first.ban").alias("ban"), F.col("_first.apt").alias("apt"))


def assign(parcels: DataFrame, ledger: DataFrame, policy: str = "min_tong", fallback: bool = True) -> DataFrame:
    """parcels with tong, ban, apt, n_cand and match (exact, bonbun, none): the exact lot first, its main number else."""
    exact = exact_candidates(ledger, policy)
    out = parcels.join(exact.withColumn("_exact", F.lit(True)), KEY, "left")
    if not fallback:
        return out.withColumn("match", F.when(F.col("_exact"), "exact").otherwise("none")).withColumn("n_cand", F.coalesce("n_cand", F.lit(0))).withColumn("apt", F.coalesce("apt", F.lit(False))).drop("_exact")
    main = main_candidates(ledger).select("legal", F.col("bon").alias("_bon"), F.col("tong").alias("_t"), F.col("ban").alias("_b"), F.col("apt").alias("_a"))
    out = out.withColumn("_bon", lots.main_number(F.col("lot"))).join(main, ["legal", "_bon"], "left")
    by_exact, by_main = F.col("_exact").isNotNull(), F.col("_t").isNotNull()
    pick = lambda a, b: F.when(by_exact, F.col(a)).otherwise(F.col(b))
    return out.select(
        *parcels.columns,
        pick("tong", "_t").alias("tong"),
        pick("ban", "_b").alias("ban"),
        F.coalesce(pick("apt", "_a"), F.lit(False)).alias("apt"),
        F.when(by_exact, F.col("n_cand")).when(by_main, 1).otherwise(0).alias("n_cand"),
        F.when(by_exact, "exact").when(by_main, "bonbun").otherwise("none").alias("match"),
    )


def conflicts(assigned: DataFrame) -> DataFrame:
    return assigned.where("n_cand > 1").select(*KEY, "tong")


def not_on_map(ledger: DataFrame, parcels: DataFrame) -> DataFrame:
    """Ledger entries whose lot, as written, is no parcel."""
    return ledger.join(parcels.select(*KEY).distinct(), KEY, "left_anti").select("tong", "ban", *KEY).distinct()


def unassigned(assigned: DataFrame) -> DataFrame:
    return assigned.where("match = 'none'").select(*KEY)


def match_summary(assigned: DataFrame) -> DataFrame:
    """Parcels by kind of match and legal district, with the share matched in percent (100 where there are none)."""
    some = F.count_if(F.col("match") != "none")
    return assigned.groupBy("legal").agg(
        *[F.count_if(F.col("match") == m).alias(f"n_{m}") for m in ("exact", "bonbun", "none")],
        F.round(F.when(F.count("*") == 0, 100.0).otherwise(100.0 * some / F.count("*")), 4).alias("matched_pct"),
    )


# Kinds and reasons of units that aren't drawn.
REASONS = {
    ("apt", False): ("아파트", "표에 지번 없음/지적도에 없음(아파트 단지명 등)"),
    ("lot", False): ("일반", "지적도에 해당 지번 없음"),
    ("apt", True): ("아파트", "지번은 지적도에 있으나 충돌(min_tong)로 다른 통에 흡수"),
    ("lot", True): ("일반", "지번은 지적도에 있으나 충돌(min_tong)로 다른 통에 흡수"),
}


def missing_units(ledger: DataFrame, assigned: DataFrame, apartment_units: DataFrame) -> DataFrame:
    """(tong, kind, reason) of units in the ledger without a parcel; apartment_units: (tong) of rows with a complex only."""
    drawn = assigned.where("tong is not null").select("tong").distinct()
    keys = assigned.select(*KEY).distinct().withColumn("_on", F.lit(1))
    units = ledger.join(drawn, "tong", "left_anti").join(keys, KEY, "left").groupBy("tong").agg(F.max("_on").alias("_on"))
    units = units.join(apartment_units.select("tong").distinct().withColumn("_apt", F.lit(1)), "tong", "left")
    apt, on = F.col("_apt").isNotNull(), F.col("_on").isNotNull()
    pick = lambda k: F.when(apt & on, REASONS["apt", True][k]).when(apt, REASONS["apt", False][k]).when(on, REASONS["lot", True][k]).otherwise(REASONS["lot", False][k])
    return units.select("tong", pick(0).alias("kind"), pick(1).alias("reason"))


def index_first(rows: DataFrame, key: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row a key: the first in order (or the last)."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) if last else F.asc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


AUDIT = ["정확", "오배정", "타동", "본번", "누락", "폐번"]


def audit(ledger: DataFrame, drawn: DataFrame, parcels: DataFrame, dong: str = "dong") -> DataFrame:
    """(dong, legal, lot, status): how each lot of the ledger came out on the map.

    ledger: (dong, legal, lot, tong, apt); drawn: (dong, legal, lot, tong); parcels: (legal, lot). In this order: drawn in its
    district for one of its units or for others, an apartment's lot (left out), drawn elsewhere, its main number drawn, a parcel
    that nobody drew, or no parcel.
    """
    said = ledger.select(dong, *KEY, "tong", F.col("apt").alias("_apt"), F.lit(False).alias("_drawn"))
    both = said.unionByName(drawn.select(dong, *KEY, "tong", F.lit(None).cast("boolean").alias("_apt"), F.lit(True).alias("_drawn")))
    flag = lambda c: F.when(F.max(c), 1)
    unit = both.groupBy(dong, *KEY, "tong").agg(F.min("_apt").alias("_apt"), F.max("_drawn").alias("_drawn"))
    out = unit.groupBy(dong, *KEY).agg(F.min("_apt").alias("_only_apt"), flag(F.col("_drawn") & F.col("_apt").isNotNull()).alias("_hit"), flag("_drawn").alias("_here")).where("_only_apt is not null")
    # What is known of a lot, and of its main number, wherever it lies.
    on_map = drawn.select(*KEY, F.lit(True).alias("_d")).unionByName(parcels.select(*KEY, F.lit(False).alias("_d")))
    known = on_map.groupBy(*KEY).agg(flag("_d").alias("_any"), flag(~F.col("_d")).alias("_lot"))
    main = known.groupBy("legal", lots.main_number(F.col("lot")).alias("_bon")).agg(F.max("_any").alias("_main"), F.max("_lot").alias("_lot_main"))
    out = out.withColumn("_bon", lots.main_number(F.col("lot"))).join(known, KEY, "left").join(main, ["legal", "_bon"], "left")
    is_ = lambda c: F.col(c).isNotNull()
    status = F.when(is_("_hit"), AUDIT[0]).when(is_("_here"), AUDIT[1]).when(F.col("_only_apt"), None).when(is_("_any"), AUDIT[2]).when(is_("_main"), AUDIT[3])
    status = F.when(is_("_hit") | is_("_here") | F.col("_only_apt") | is_("_any") | is_("_main"), status).when(is_("_lot") | is_("_lot_main"), AUDIT[4]).otherwise(AUDIT[5])
    return out.select(dong, *KEY, status.alias("status")).where("status is not null")


def top_lots(rows: DataFrame, key: list[str], most: int, name: str) -> DataFrame:
    """(key, name): the first `most` lots of each key, in order; no more than these are gathered."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy("lot"))
    return rows.select(*key, "lot").withColumn("_n", n).where(F.col("_n") <= most).groupBy(*key).agg(F.array_sort(F.collect_list("lot")).alias(name))


def suspects_by_district(found: DataFrame) -> DataFrame:
    """(legal, n_bons, n_lots): how many main numbers of a district, and lots of them, anomalies() suspects."""
    return found.groupBy("legal").agg(F.count("*").alias("n_bons"), F.sum("n").alias("n_lots"))


def anomalies(ledger: DataFrame, assigned: DataFrame) -> DataFrame:
    """(legal, bon, n, sample, tongs, bare): main numbers with unassigned sub lots though they are assigned or listed bare."""
    bon = lots.main_number(F.col("lot")).alias("bon")
    free = assigned.where("tong is null").select("legal", bon, "lot")
    first = top_lots(free, ["legal", "bon"], 4, "sample")
    free = free.groupBy("legal", "bon").agg(F.count("*").alias("n")).join(first, ["legal", "bon"])
    taken = assigned.where("tong is not null").groupBy("legal", bon).agg(F.array_sort(F.collect_set("tong")).alias("tongs"))
    bare = ledger.where(~F.col("apt") & ~F.col("lot").contains("-")).groupBy("legal", F.col("lot").alias("bon")).agg(F.array_sort(F.collect_set("tong")).alias("bare"))
    none = F.array().cast("array<int>")
    out = free.join(taken, ["legal", "bon"], "left").join(bare, ["legal", "bon"], "left").where("tongs is not null or bare is not null")
    return out.select("legal", "bon", "n", "sample", F.coalesce("tongs", none).alias("tongs"), F.coalesce("bare", none).alias("bare"))
