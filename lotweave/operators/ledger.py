"""Ledger expansion: a row's free text becomes lots, complexes without lots, and failures. Windows run within a row only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotweave.functions import lots

# Fixed value: words that say a segment names an apartment or a unit of one.
APARTMENT = r"아파트|빌라|연립|상가|단지|타운|마을|푸르지오|레이크|클래스|호반|어울림|센트럴|스타힐스|그린빌|건영|세원|삼호|혜성|건안|더존|중흥|호수|써밋|Ⓐ|\d+호|\d+동"


def words_of(ledger: DataFrame, districts: list[str] | Column, row: str = "row_no", area: str = "area", apartment: str = APARTMENT) -> DataFrame:
    """(row, seg, at, legal, apt, body, word) in the ledger's order: one row a word that can be a lot, and one without a word for other segments.

    A segment that begins with a known district switches to it; a word with Hangul that is no lot ends its segment.
    """
    known = F.array(*map(F.lit, districts)) if isinstance(districts, list) else districts
    text = lots.mark_parentheses(lots.normalize_text(F.col(area)))
    segs = ledger.select("*", F.posexplode(F.split(text, ",")).alias("seg", "_s")).withColumn("_s", F.trim(F.col("_s"))).where("_s <> ''")
    name = F.regexp_extract("_s", lots.DISTRICT, 1)
    segs = segs.withColumn("_new", F.when((name != "") & F.array_contains(known, name), name))
    order = Window.partitionBy(row).orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    segs = segs.select(
        "*",
        F.last("_new", True).over(order).alias("legal"),
        F.count("_new").over(order).alias("_part"),
        F.col("_s").rlike(apartment).alias("apt"),
        F.when(F.col("_new").isNull(), F.col("_s")).otherwise(F.btrim(F.regexp_extract("_s", lots.DISTRICT, 2))).alias("body"),
    )
    split = F.when(F.col("legal").isNotNull(), F.split("body", r"\s+")).otherwise(F.array().cast("array<string>"))
    cleaned = F.filter(F.transform(split, lots.clean_word), lambda w: w != "")
    ends = F.transform(cleaned, lambda w: w.rlike("[가-힣]") & ~w.rlike(lots.LOT_OR_MOUNTAIN_RANGE))
    stop = F.array_position(ends, F.lit(True))
    front = F.when(stop > 0, F.slice(cleaned, F.lit(1), (stop - 1).cast("int"))).otherwise(cleaned)
    front = F.filter(front, lambda w: w.contains("~산") | w.rlike(lots.LOT))
    return segs.withColumn("_words", front).select("*", F.posexplode_outer("_words").alias("at", "word")).drop("_words", "_new", "_s")


def expand_ledger(ledger: DataFrame, districts: list[str] | Column, row: str = "row_no", area: str = "area", apartment: str = APARTMENT) -> DataFrame:
    """(row, seg, at, n, kind, legal, lot, apt): kind is lot, apartment (a segment without lots; lot is its text) or failed.

    After a lot with a sub number, a bare number also stands for that sub number of the same main number, until a district,
    a mountain lot or an unreadable main number comes.
    """
    words = words_of(ledger, districts, row, area, apartment)
    w = F.col("word")
    mountain_range = w.contains("~산")
    mountain = w.startswith(lots.MOUNTAIN)
    core = F.btrim(F.when(mountain, F.substr(w, F.lit(2))).otherwise(w), F.lit("-~ㆍ"))
    words = words.withColumn("_core", core).withColumn("_mr", mountain_range).withColumn("_m", mountain)
    found = F.when(F.col("_mr"), lots.expand_mountain_range(w)).when(w.isNotNull(), lots.expand_spec(F.col("_core"), F.col("_m")))
    words = words.withColumn("_found", found).withColumn("_lots", F.when(F.size("_found") > 0, F.col("_found")))
    # What a word leaves for the next ones: '' forgets, a number is remembered, null changes nothing.
    bon = F.coalesce(F.split_part("_core", F.lit("-"), F.lit(1)).try_cast("bigint").cast("string"), F.lit(""))
    leaves = F.when(F.col("_mr"), "").when(F.col("_lots").isNull(), None).when(F.col("_m"), "").when(F.col("_core").contains("-"), bon)
    before = Window.partitionBy(row, "_part").orderBy("seg", "at").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("_leaves", leaves).withColumn("_bon", F.last("_leaves", True).over(before))
    bare = ~F.col("_mr") & ~F.col("_m") & ~F.col("_core").contains("-") & (F.col("_bon") != "")
    more = F.when(bare, F.transform("_lots", lambda x: F.concat(F.col("_bon"), F.lit("-"), x))).otherwise(F.array().cast("array<string>"))
    words = words.withColumn("_all", F.when(F.col("_lots").isNotNull(), F.concat("_lots", F.coalesce(more, F.array().cast("array<string>")))))
    words = words.withColumn("_got", F.count("_all").over(Window.partitionBy(row, "seg")))
    # All that a word says, in one array, so that the words are read once.
    entry = lambda kind, n, lot, legal="legal": F.struct(n.cast("int").alias("n"), F.lit(kind).alias("kind"), F.col(legal).alias("legal") if legal else F.lit("").alias("legal"), lot.alias("lot"))
    zero = F.lit(0)
    own = F.when(F.col("legal").isNull(), F.array(entry("failed", zero, F.col("body"), None))).when(F.col("_all").isNotNull(), F.transform("_all", lambda x, i: entry("lot", i, x))).when(w.isNotNull(), F.array(entry("failed", zero, w)))
    named = F.col("legal").isNotNull() & (F.col("_got") == 0) & (F.col("body") != "") & (F.coalesce("at", zero) == 0)
    said = F.concat(F.coalesce(own, F.array()), F.coalesce(F.when(named, F.array(entry("apartment", zero, F.col("body")))), F.array()))
    return words.select(row, "seg", "at", "apt", F.inline(said)).select(row, "seg", "at", "n", "kind", "legal", "lot", "apt")


def group_paragraphs(paragraphs: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Paragraphs of a cell as numbered blocks: one begins at each paragraph that doesn't start with a lot (a digit, or 산 and a digit)."""
    running = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(group).orderBy(order)) == 1
    starts = first | ~F.col(text).rlike(r"^\s*(\d|산\s*\d)")  # an empty paragraph begins one too
    numbered = paragraphs.withColumn("_first", first).withColumn("_start", starts).withColumn("block", F.sum(F.col("_start").cast("int")).over(running).cast("int"))
    return numbered.groupBy(group, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), " ").alias("text"))


def label_mismatch(label: Column, n: Column) -> Column:
    """Whether a block label's digits aren't 1, 2, ... n written one after the other."""
    expected = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda x: x.cast("string")), "")
    return F.regexp_replace(label, r"\D", "") != F.when(n >= 1, expected).otherwise("")


def carry_forward(df: DataFrame, group: list[str], order: list[str], *columns: str) -> DataFrame:
    """Nulls take the last value before them."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, True).over(w) for c in columns})
