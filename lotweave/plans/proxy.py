"""Domain tables derived from the driver's tables, by expressions that Spark and DuckDB read alike. All rows are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The ledger's order; unique over lineitem.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]

_BON = "CAST((l_orderkey * 31 + l_partkey) % 4999 + 1 AS STRING)"

#: name: (source table, expressions)
PROXIES: dict[str, tuple[str, list[str]]] = {
    # A parcel for each order: its 19-digit key.
    "parcel": (
        "orders",
        [
            "o_orderkey AS id",
            "'41390' || lpad(CAST(o_custkey % 5 + 1 AS STRING), 5, '0') || CASE WHEN o_orderstatus = 'P' THEN '2' ELSE '1' END || lpad(CAST((o_orderkey * 13) % 4999 + 1 AS STRING), 4, '0') || lpad(CAST(o_orderkey % 7 AS STRING), 4, '0') AS pnu",
        ],
    ),
    # A ledger entry for each line.
    "ledger": (
        "lineitem",
        [
            "CAST((l_orderkey + 3 * l_partkey) % 40 + 1 AS INT) AS tong",
            "l_linenumber AS ban",
            "'413900000' || CAST(l_suppkey % 5 + 1 AS STRING) AS legal",
            f"CASE WHEN l_partkey % 4 = 0 THEN '산' ELSE '' END || {_BON} || CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE '-' || CAST(l_linenumber - 1 AS STRING) END AS lot",
            "l_returnflag = 'R' AS apt",
            *ORDER,
        ],
    ),
    # A lot spec for each line; all forms of the grammar, readable or not.
    "spec": (
        "lineitem",
        [
            *ORDER,
            "CASE WHEN l_orderkey % 10 = 9 THEN true ELSE false END AS mountain",
            """CASE WHEN l_partkey % 50 = 0 THEN b || '~' || CAST(bn + 2000 AS STRING) WHEN l_partkey % 50 = 1 THEN b || '-' || CAST(s + 5 AS STRING) || '~' || sn
 WHEN l_orderkey % 10 = 0 THEN b WHEN l_orderkey % 10 = 1 THEN b || '-' || sn WHEN l_orderkey % 10 = 2 THEN b || '~' || CAST(bn + s AS STRING)
 WHEN l_orderkey % 10 = 3 THEN b || '-' || sn || '~' || CAST(s + 3 AS STRING) WHEN l_orderkey % 10 = 4 THEN b || '~' || CAST(bn + 2 AS STRING) || '-' || sn
 WHEN l_orderkey % 10 = 5 THEN b || '-' || sn || '~' || b || '-' || CAST(s + 2 AS STRING) WHEN l_orderkey % 10 = 6 THEN b || '-' || sn || '~' || CAST(bn + 2 AS STRING) || '-' || sn
 WHEN l_orderkey % 10 = 7 THEN b || '-1ㆍ2ㆍ3~5' WHEN l_orderkey % 10 = 8 THEN CAST(bn + s AS STRING) || '~1' ELSE b || '~' || CAST(bn + s AS STRING) END AS core""",
        ],
    ),
    # Mountain ranges whose right end says so.
    "mountain_range": (
        "lineitem",
        [
            *ORDER,
            """CASE WHEN l_partkey % 4 = 0 THEN '산' || b || '-' || sn || '~산' || CAST(bn + s AS STRING) WHEN l_partkey % 4 = 1 THEN b || '-' || sn || '~산' || b || '-' || CAST(s + 2 AS STRING)
 WHEN l_partkey % 4 = 2 THEN '산' || b || '~산' || CAST(bn - s AS STRING) ELSE '산' || b || '~산' || CAST(bn + 1 AS STRING) || '-' || sn END AS word""",
        ],
    ),
    "point": ("embeddings", ["vec_id AS id", "CAST(embedding[{0}] AS DOUBLE) * 1000 AS x", "CAST(embedding[{1}] AS DOUBLE) * 1000 AS y", "label AS tong"]),
}

#: Columns that spec and mountain_range are written with.
_INNER = "(SELECT *, CAST(l_partkey % 900 + 10 AS STRING) AS b, l_partkey % 900 + 10 AS bn, l_linenumber AS s, CAST(l_linenumber AS STRING) AS sn FROM lineitem)"


def sql(name: str) -> str:
    """The proxy as a DuckDB subquery."""
    table, columns = PROXIES[name]
    source = _INNER if name in ("spec", "mountain_range") else table
    return f"(SELECT {', '.join(columns).format(1, 2) if name == 'point' else ', '.join(columns)} FROM {source})"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = PROXIES[name]
    df = read(spark, sf_dir, table)
    if name in ("spec", "mountain_range"):
        df = df.selectExpr("*", "CAST(l_partkey % 900 + 10 AS STRING) AS b", "l_partkey % 900 + 10 AS bn", "l_linenumber AS s", "CAST(l_linenumber AS STRING) AS sn")
    return df.selectExpr(*[c.format(0, 1) if name == "point" else c for c in columns])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
