"""Secret scans (operator 2): strong single patterns, and weak parts linked into multipart credentials. Built-ins only.

Strong patterns (assign, access, hex) are always reported. Weak parts are not secrets by themselves: names of an account or
client (ident), long mixed runs (blob) and addresses (endpoint). They are binned by their start into scopes of `scope` code
points and interval-joined, by document and bin, to what each neighbouring bin holds of the complementary parts; one is
reported only if those co-occur within `scope` code points:
  ident     with a secret (assign, hex or blob),
  blob      with an identifier (access or ident),
  endpoint  with both a secret and an identifier.
A bin is first summed up as its least and greatest start by role, so the join gives three rows a part at most, however many
parts a scope holds.

Defined cases: null text counts as empty; a text without parts has empty spans; equal rows (same id, same text) each give
the same row; an id that repeats with other texts is
kept apart by a digest of id and text, which is what parts are joined by. Positions are code points, the end
is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.llm.common import documents, durable

# The base patterns, with the least length of what must be as long.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
LONG_HEX = r"[0-9a-f]{32,}"  # whole runs of 32 and more
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

IDENT = r"""(?i)(client_?id|access_?key_?id|account|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)"""
BLOB = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?"""

#: Kinds in the order that breaks ties between equal starts; a kind's role.
KINDS = ["assign", "access", "hex", "ident", "blob", "endpoint"]
ROLE = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "ident", "ident": "ident", "endpoint": "endpoint"}

_SPAN = "struct<start:int,end:int,rank:int,kind:string>"
_BLOCK = 256  # a fold copies what it has gathered at each step, so it gathers in blocks


def find(text: Column, pattern: str, kind: str, keep=None, guard: Column | None = None) -> Column:
    """array<struct<start, end, rank, kind>> of the pattern's leftmost non-overlapping matches that keep() accepts.

    Matches and the gaps between them are folded in order, which gives each match's place. guard: a cheap condition without
    which the text has no match.
    """
    # The last gap has no match after it.
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    none = F.array().cast(f"array<{_SPAN}>")
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("done"), none.alias("now"))

    def step(acc: Column, x: Column) -> Column:
        begins = acc["at"] + F.length(x["g"])
        ends = begins + F.coalesce(F.length(x["m"]), F.lit(0))
        full = F.size(acc["now"]) >= _BLOCK
        span = F.struct(begins.alias("start"), ends.alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"))
        good = x["m"].isNotNull() if keep is None else F.coalesce(keep(x["m"]), F.lit(False))
        now = F.when(full, none).otherwise(acc["now"])
        return F.struct(
            ends.alias("at"),
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(good, F.concat(now, F.array(span))).otherwise(now).alias("now"),
        )

    spans = F.aggregate(pieces, start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))
    return F.when(text.rlike(pattern) if guard is None else guard, spans).otherwise(none)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, weak, digest): strong spans and weak parts of each text, arrays in order of start."""
    narrow = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = F.col("_t")
    base = F.concat(
        find(t, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_ASSIGN),
        find(t, ACCESS, "access", lambda m: F.length(m) >= LEAST_ACCESS, t.contains("AKIA")),
        find(t, LONG_HEX, "hex"),
    )
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    weak = F.concat(find(t, IDENT, "ident"), find(t, BLOB, "blob", mixed), find(t, ENDPOINT, "endpoint"))
    return narrow.select(key, F.array_sort(base).alias("base"), F.array_sort(weak).alias("weak"), F.when((F.size(base) > 0) | (F.size(weak) > 0), F.sha2(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("-")), F.lit(" "), t), 256)).alias("digest"))


def link(parts: DataFrame, scope: int, by: tuple[str, ...]) -> DataFrame:
    """Those weak parts (by, start, end, rank, kind) whose complementary parts start within `scope` code points."""
    roles = sorted(set(ROLE.values()))
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])[F.col("kind")]
    parts = parts.withColumn("_bin", F.floor(F.col("start") / scope).cast("int")).withColumn("_role", role)
    bins = parts.groupBy(*by, "_bin").agg(
        *[F.min(F.when(F.col("_role") == r, F.col("start"))).alias(f"_first_{r}") for r in roles],
        *[F.max(F.when(F.col("_role") == r, F.col("start"))).alias(f"_last_{r}") for r in roles],
    )
    weak = parts.where(F.col("rank") >= 3).withColumn("_at", F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1)))
    met = weak.join(bins.withColumnRenamed("_bin", "_at"), [*by, "_at"])
    near = {r: F.when(F.col("_at") < F.col("_bin"), F.col("start") - F.col(f"_last_{r}") <= scope).when(F.col("_at") > F.col("_bin"), F.col(f"_first_{r}") - F.col("start") <= scope).otherwise(F.col(f"_first_{r}").isNotNull()) for r in roles}
    seen = met.groupBy(*by, "start", "end", "rank", "kind").agg(*[F.max(F.coalesce(near[r], F.lit(False))).alias(f"_near_{r}") for r in roles])
    has = lambda r: F.col(f"_near_{r}")
    linked = F.when(F.col("kind") == "ident", has("secret")).when(F.col("kind") == "blob", has("ident")).otherwise(has("secret") & has("ident"))
    return seen.where(linked).select(*by, "start", "end", "rank", "kind")


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", scope: int = 200) -> DataFrame:
    """(key, base, spans) for every row: array<struct<start, end, rank, kind>>, spans with the linked weak parts."""
    found = durable(scan(df, key, text))
    parts = found.where("digest is not null").select("digest", F.explode(F.concat("base", "weak")).alias("p")).select("digest", "p.*")
    linked = link(parts, scope, ("digest",)).groupBy("digest").agg(F.collect_list(F.struct("start", "end", "rank", "kind")).alias("linked"))
    rows = found.where("digest is not null").join(linked, "digest", "left")
    # Texts without parts have no digest; they'd all meet in one task of the join.
    rows = rows.unionByName(found.where("digest is null"), allowMissingColumns=True)
    # By start, then kind as listed.
    order = lambda a: F.array_sort(a, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).when(x["rank"] != y["rank"], x["rank"] - y["rank"]).otherwise(x["end"] - y["end"]))
    return rows.select(key, order(F.col("base")).alias("base"), order(F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.concat("base", "linked"))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    least = {"assign": f"length(regexp_extract(m[i], {q(ASSIGN)}, 2)) >= {LEAST_ASSIGN}", "access": f"length(m[i]) >= {LEAST_ACCESS}", "blob": "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[a-z]')"}
    one = []
    for k, (kind, p) in enumerate(zip(KINDS, [ASSIGN, ACCESS, LONG_HEX, IDENT, BLOB, ENDPOINT], strict=True)):
        one.append(f"""SELECT doc_id, {k} AS rank, '{kind}' AS kind, list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i-1], lambda x: length(x))), 0) AS s, length(m[i]) AS n
 FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {q(p)}) AS m, string_split_regex(t, {q(p)}) AS g FROM d)) WHERE {least.get(kind, 'true')}""")
    near = lambda role: f"EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = p.doc_id AND o.kind IN ({', '.join(q(k) for k in KINDS if ROLE[k] == role)}) AND abs(o.s - p.s) <= 200)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({" UNION ALL ".join(one)}),
said AS (SELECT doc_id, rank, kind, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS w FROM parts p
 WHERE rank < 3 OR (kind = 'ident' AND {near('secret')}) OR (kind = 'blob' AND {near('ident')}) OR (kind = 'endpoint' AND {near('secret')} AND {near('ident')})),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 string_agg(w, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(w, ',' ORDER BY s, rank) AS spans FROM said GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""


QUERIES = {"op2_secrets": op2_secrets}
ORACLE_SQL = {"op2_secrets": _sql()}
