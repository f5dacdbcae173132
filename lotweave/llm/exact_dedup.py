"""Exact dedup by deterministic block naming (operator 8). Built-ins only.

Each text is cut into blocks of `block` characters. Blocks are sorted within the bucket of their 64-bit code, and a block's
integer name is (code, rank among the different blocks of that bucket); so two blocks have the same name only if they are
equal, whatever the code does. Adjacent names are then paired and the pairs named in the same way, level by level, until one
name is left of each text. With its length in levels, that name is the text's collision-free identity.

Where no bucket of a level holds two different things, all ranks are 0 and names need no exchange of texts: one aggregation
by code (least and greatest content of a bucket) shows that. Only the content of buckets with more is ranked and joined.

Defined cases: null counts as empty, and an empty text is one empty block; of equal texts the largest key stays (a null key
only if there is no other); of rows that repeat with that key and text, one stays; other columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotweave.llm.common import documents, durable

BLOCK = 1024


def code(what: Column, bits: int) -> Column:
    """The bucket of a block or pair; fewer bits make buckets hold more (for tests)."""
    h = F.xxhash64(what)
    return h if bits >= 64 else F.pmod(h, F.lit(1 << bits))


def blocks_of(text: Column, block: int) -> Column:
    last = F.greatest(F.ceil(F.length(text) / block).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * block + 1, F.lit(block)))


def pairs_of(names: Column) -> Column:
    """Adjacent names two by two; the last of an odd number is paired with null."""
    half = F.sequence(F.lit(0), F.floor((F.size(names) - 1) / 2).cast("int"))
    return F.transform(half, lambda i: F.struct(F.get(names, 2 * i).alias("a"), F.get(names, 2 * i + 1).alias("b")))


def crowded(items: DataFrame) -> DataFrame | None:
    """(code, what, rank) of buckets with several different contents, if there are any; items: (code, what)."""
    several = items.groupBy("code").agg(F.min("what").alias("least"), F.max("what").alias("most")).where("least < most").select("code")
    if not several.limit(1).count():
        return None
    different = items.join(durable(several), "code", "left_semi").distinct()
    return durable(different.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("what")) - 1))


def named(what: Column, bits: int) -> Column:
    """Names of an array's items where all ranks are 0."""
    return F.transform(what, lambda x: F.struct(code(x, bits).alias("code"), F.lit(0).alias("rank")))


def ranked(items: DataFrame, ranks: DataFrame, ids: list[str]) -> DataFrame:
    """Arrays of names by ids; items: (ids, at, code, what)."""
    met = items.join(ranks, ["code", "what"], "left")
    name = F.struct("at", F.struct(F.col("code"), F.coalesce("rank", F.lit(0)).alias("rank")).alias("name"))
    found = met.groupBy(*ids).agg(F.array_sort(F.collect_list(name)).alias("names"))  # as many as a text has blocks
    return found.withColumn("names", F.transform("names", lambda x: x["name"]))


def identities(df: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, bits: int = 64) -> DataFrame:
    """(row, key, levels, name, text_sha256) of each row: equal (levels, name) if and only if the texts are equal.

    row numbers the rows; it is written with the names, so it stays the same however often the result is read.
    """
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = docs.select("row", "_key", F.sha2("_t", 256).alias("sha"), blocks_of(F.col("_t"), block).alias("what"))
    ranks = crowded(rows.select(F.explode("what").alias("what")).select(code(F.col("what"), bits).alias("code"), "what"))
    if ranks is None:
        level = rows.withColumn("names", named(F.col("what"), bits)).drop("what")
    else:
        items = rows.select("row", "_key", "sha", F.posexplode("what").alias("at", "what")).withColumn("code", code(F.col("what"), bits))
        level = ranked(items, ranks, ["row", "_key", "sha"])
    level, n, done = durable(level), 0, []
    while True:
        done.append(level.where(F.size("names") == 1).withColumn("levels", F.lit(n)))
        # Texts that have their one name are set aside; only the others are halved.
        more = level.where(F.size("names") > 1)
        if not more.limit(1).count():
            break
        more = more.withColumn("pairs", pairs_of(F.col("names")))
        items = more.select("row", F.posexplode("pairs").alias("at", "what")).withColumn("code", code(F.col("what"), bits))
        ranks = crowded(items.select("code", "what"))
        if ranks is None:
            more = more.withColumn("names", named(F.col("pairs"), bits))
        else:
            more = more.drop("names").join(ranked(items, ranks, ["row"]), "row")
        level, n = durable(more.select("row", "_key", "sha", "names")), n + 1
    found = functools.reduce(DataFrame.unionByName, done)
    return found.select("row", F.col("_key").alias(key), "levels", F.get("names", F.lit(0)).alias("name"), F.col("sha").alias("text_sha256"))


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, bits: int = 64) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of each row."""
    found = identities(df, key, text, block, bits).withColumn("code", F.col("name.code")).withColumn("rank", F.col("name.rank"))
    several = found.groupBy("levels", "code", "rank").agg(F.count("*").alias("n"), F.max(F.struct(F.col(key), F.col("row"))).alias("best")).where("n > 1")
    # Written first, so that the join deals both sides out anew and can split the rows of a large group.
    met = found.join(durable(several), ["levels", "code", "rank"], "left")
    return met.select(
        F.col(key),
        F.when(F.col("n").isNull(), F.col(key)).otherwise(F.col(f"best.{key}")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows without all but one of each group of equal texts, with df's columns."""
    found = durable(groups(df, key, text))
    gone = found.where("not kept").select(F.col(key).alias("_key"), F.col("text_sha256").alias("_sha"), F.lit(True).alias("_gone"))
    stays = found.where("kept").select(F.col(key).alias("_key"), F.col("text_sha256").alias("_sha"))
    same = lambda other: F.col(key).eqNullSafe(other["_key"]) & (F.sha2(F.coalesce(F.col(text), F.lit("")), 256) == other["_sha"])
    twice = durable(gone.join(stays, ["_sha"]).where(gone["_key"].eqNullSafe(stays["_key"])).select(gone["_key"], "_sha").distinct())
    if not twice.limit(1).count():
        return df.join(gone, same(gone), "left_anti")
    # Some rows repeat with id and text: one of each of these stays.
    gone = gone.join(twice, "_sha", "left_anti").unionByName(gone.join(twice.withColumnRenamed("_key", "_k"), "_sha").where(~F.col("_key").eqNullSafe(F.col("_k"))).drop("_k"))
    rest = df.join(gone, same(gone), "left_anti")
    again = rest.join(twice, same(twice), "left_semi").dropDuplicates([key, text])
    return rest.join(twice, same(twice), "left_anti").unionByName(again)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLE_SQL = {
    "op8_exact_dedup": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
