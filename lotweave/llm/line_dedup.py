"""Line dedup by distinct-site spread (operator 7). Built-ins only.

Each line's sites are gathered in a HyperLogLog sketch by the line's 64-bit code; partial sketches merge on the way to the
aggregation, so a line on all pages costs a sketch a task. Lines whose estimate lies well above the threshold are boilerplate,
lines well below are not, and for lines near it the distinct sites are counted exactly. Then the boilerplate lines leave the
texts.

Lines are what lies between line feeds, without blanks around; empty lines are left alone. Defined cases: a null text stays
null and has no lines; null sites are one site of their own; equal rows are treated alike; texts of any length are handled
whole; a text that was all boilerplate becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.llm.common import documents, durable

MIN_SITES = 5
LG_K = 10  # sketches of 1,024 registers: a standard error of about 3 %
MARGIN = 0.15  # estimates this close to the threshold are counted exactly


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_code(line: Column) -> Column:
    """The code of a line; null if it is blank."""
    bare = F.trim(line)
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(df: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(code, n_sites) of the lines on at least min_sites sites; n_sites is exact near the threshold and estimated beyond."""
    each = df.select(F.coalesce(F.col(site), F.lit("\x00")).alias("site"), F.explode(F.transform(lines_of(F.col(text)), line_code)).alias("code")).where("code is not null")
    spread = each.groupBy("code").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about"))
    some = durable(spread.where(F.col("about") >= min_sites * (1 - MARGIN)))
    near = some.where(F.col("about") < min_sites * (1 + MARGIN)).select("code")
    # Distinct first: then a line has a row a site and none is frequent.
    exact = each.distinct().join(near, "code", "left_semi").groupBy("code").agg(F.count("*").alias("n_sites")).where(F.col("n_sites") >= min_sites)
    sure = some.where(F.col("about") >= min_sites * (1 + MARGIN)).select("code", F.col("about").alias("n_sites"))
    return durable(exact.unionByName(sure))


def removed_lines(df: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _hash, _gone): places of the boilerplate lines of each text that has some, by key and code of the text."""
    lines = df.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.posexplode(F.transform(lines_of(F.col(text)), line_code)).alias("_at", "code"))
    hit = lines.where("code is not null").join(common.select("code"), "code")
    return hit.groupBy("_key", "_hash").agg(F.collect_set("_at").alias("_gone"))


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """df with its texts free of boilerplate lines, and the numbers of lines before (n_lines) and removed (n_removed)."""
    common = boilerplate(df, text, site, min_sites)
    gone = durable(removed_lines(df, common, key, text))
    # The lines travel in place of the text, so that they are split once; what stays is found in one pass over hashed places.
    each = df.select(*[c for c in df.columns if c != text], lines_of(F.col(text)).alias("_lines"), F.xxhash64(text).alias("_own"))
    met = each.join(gone, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_hash")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.transform(stay, lambda i: F.get("_lines", i)))
    clean = F.array_join(kept, "\n")
    n_lines = F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines"))
    added = {"n_lines": n_lines.cast("long"), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    return met.select(*[clean.alias(c) if c == text else F.col(c) for c in df.columns if c not in added], *[e.alias(c) for c, e in added.items()])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"), "text")


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE_SQL = {
    "op7_line_dedup": """WITH lines AS (SELECT doc_id, coalesce(source, chr(0)) AS site, i, l[i] AS line FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i
 FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))),
common AS (SELECT trim(line, ' ') AS bare FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 5),
marked AS (SELECT doc_id, i, line, trim(line, ' ') IN (SELECT bare FROM common) AS gone FROM lines),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(a.text) AS text_sha256, a.text FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id"""
}
