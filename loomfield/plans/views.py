"""The driver's tables seen as a graph, as papers and as job logs; each with the SQL of the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.sources.tables import dealt, parts, table

#: (table, key, name, type)
KINDS = [
    ("region", "r_regionkey", "r_name"),
    ("nation", "n_nationkey", "n_name"),
    ("customer", "c_custkey", "c_name"),
    ("supplier", "s_suppkey", "s_name"),
    ("part", "p_partkey", "p_name"),
]
#: (table, source type, source key, target type, target key) of the plain belongs_to edges
LINKS = [
    ("nation", "nation", "n_nationkey", "region", "n_regionkey"),
    ("customer", "customer", "c_custkey", "nation", "c_nationkey"),
    ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
]


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}#"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, type, domain, name): regions are in ``default``, the rest has no domain."""
    found = None
    for name, key, label in KINDS:
        domain = F.lit("default") if name == "region" else F.lit(None).cast("string")
        part = table(spark, sf, name).select(_id(name, key).alias("id"), F.lit(name).alias("type"), domain.alias("domain"), F.col(label).alias("name"))
        found = part if found is None else found.unionByName(part)
    return found


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """(id, source_id, target_id, type, confidence): places belong_to places, suppliers supply parts."""
    found = None
    for name, kind, key, up, ref in LINKS:
        part = table(spark, sf, name).select(_id(kind, key).alias("source_id"), _id(up, ref).alias("target_id"), F.lit("belongs_to").alias("type"), F.lit(1.0).alias("confidence"))
        found = part if found is None else found.unionByName(part)
    cents = F.expr("(100 * count(*) - sum(cast(round(l_discount * 100) as bigint))) div count(*)")
    lines = table(spark, sf, "lineitem")
    sold = dealt(lines.select("l_suppkey", "l_partkey", "l_discount"), parts(lines), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg((cents / 100.0).alias("confidence"))
    sold = sold.select(_id("supplier", "l_suppkey").alias("source_id"), _id("part", "l_partkey").alias("target_id"), F.lit("supplies").alias("type"), "confidence")
    return found.unionByName(sold).withColumn("id", F.concat_ws("|", "source_id", "type", "target_id"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Links between pages, (source_id, target_id), both as addresses; repeated links once."""
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))
    return table(spark, sf, "pages").select(F.col("url").alias("source_id"), links.alias("target_id")).distinct()


NODES_SQL = "nodes AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{n}#' || {k} AS id, '{n}' AS type, {chr(39) + 'default' + chr(39) if n == 'region' else 'CAST(NULL AS VARCHAR)'} AS domain, {l} AS name FROM {n}" for n, k, l in KINDS
) + ")"
EDGES_SQL = "edges AS MATERIALIZED (SELECT source_id || '|' || type || '|' || target_id AS id, * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}#' || {k} AS source_id, '{b}#' || {r} AS target_id, 'belongs_to' AS type, CAST(1 AS DOUBLE) AS confidence FROM {t}" for t, a, k, b, r in LINKS
) + """ UNION ALL SELECT 'supplier#' || l_suppkey, 'part#' || l_partkey, 'supplies',
 CAST((100 * count(*) - CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT)) // count(*) AS DOUBLE) / 100
 FROM lineitem GROUP BY l_suppkey, l_partkey))"""
ENDS_SQL = "walk AS MATERIALIZED (SELECT source_id AS node, target_id AS peer, confidence AS w FROM edges UNION ALL SELECT target_id, source_id, confidence FROM edges WHERE source_id <> target_id)"
GRAPH_SQL = f"{NODES_SQL}, {EDGES_SQL}, {ENDS_SQL}"
