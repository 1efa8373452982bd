"""Counts, maintenance, queues and rate limits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.operators import dataflow, evaluation, maintenance
from loomfield.plans.views import EDGES_SQL, GRAPH_SQL, NODES_SQL, edges, nodes
from loomfield.sources.tables import table


def stats_by_type(spark: SparkSession, sf: str) -> DataFrame:
    counted = edges(spark, sf).groupBy("type").agg(F.count("*").alias("n"))
    return nodes(spark, sf).groupBy("type").agg(F.count("*").alias("n")).unionByName(counted)


def type_share(spark: SparkSession, sf: str) -> DataFrame:
    counts = nodes(spark, sf).groupBy("type").agg(F.count("*").alias("n"))
    return evaluation.shares(counts).select("type", F.round("share", 4).alias("share"), F.round("relative", 4).alias("relative"))


def conditional_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("processed"))


def null_domain_counts(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.adopt(nodes(spark, sf), "atlas").groupBy("domain").agg(F.count("*").alias("n"))


def orphan_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Supplies edges of which no line was returned."""
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    sources = lines.select(F.concat(F.lit("supplier#"), "l_suppkey", F.lit("|supplies|part#"), "l_partkey").alias("edge_id"))
    return maintenance.orphans(edges(spark, sf).where("type = 'supplies'"), sources).select("id")


def missing_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an urgent order."""
    orders = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey")


def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    """Edges marked with the domain of their target differ from that of their source."""
    at = nodes(spark, sf).select(F.col("id").alias("target_id"), "domain")
    marked = edges(spark, sf).join(at, "target_id")
    return maintenance.drifted(marked, nodes(spark, sf)).groupBy("type", "target_id").agg(F.count("*").alias("n"))


def upserted_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    state = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.lit(0).alias("version"))
    change = state.where("s_suppkey % 3 = 0").withColumn("s_nationkey", F.lit(99)).withColumn("version", F.lit(1))
    return maintenance.upsert(state, change, ["s_suppkey"], "version").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey"))


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as jobs: users are papers, event types are lanes, purchases are owned."""
    owner = F.when(F.col("event_type") == "purchase", F.lit("worker"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("paper_id"), F.col("event_type").alias("lane"), F.col("ts").alias("created_at"), owner.alias("owner"))


def keep_one_live_job(spark: SparkSession, sf: str) -> DataFrame:
    return dataflow.keep_one_live_job(_jobs(spark, sf), "paper_id").select("paper_id", "id")


def queue_position(spark: SparkSession, sf: str) -> DataFrame:
    return dataflow.queue_position(_jobs(spark, sf), "lane").select("id", "lane", F.col("position").cast("long").alias("position"))


def claims(spark: SparkSession, sf: str) -> DataFrame:
    return dataflow.claim(_jobs(spark, sf), "lane", 2).select("id", "lane")


def lane_depth(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).groupBy("lane").agg(F.count_if(F.col("owner").isNull()).alias("queued"), F.count_if(F.col("owner").isNotNull()).alias("running"))


def rate_limit_fixed(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.unix_timestamp("ts")
    judged = dataflow.rate_limit(table(spark, sf, "events"), "user_id", seconds, 86400, 2)
    return judged.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


def error_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Errors count as an unavailable service, signups as failures of another kind, all else as successes."""
    log = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return dataflow.failure_runs(log, "user_id", "event_id", F.col("event_type") == "error", F.col("event_type") == "signup")


def comentioned_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of parts of one order and one brand, counted."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    a = lines.join(brands, "l_partkey")
    b = a.select("l_orderkey", F.col("l_partkey").alias("other"), "p_brand")
    return a.join(b, ["l_orderkey", "p_brand"]).where("l_partkey < other").groupBy("l_partkey", "other").agg(F.count("*").alias("n"))


def previous_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The end of the preceding turn, as overlap before each turn."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.right(before, F.lit(200)), F.lit("")).alias("overlap"))


JOBS_SQL = "jobs AS (SELECT event_id AS id, user_id AS paper_id, event_type AS lane, ts AS created_at, CASE WHEN event_type = 'purchase' THEN 'worker' END AS owner FROM events)"

QUERIES = {
    "stats_by_type": (stats_by_type, f"WITH {GRAPH_SQL} SELECT type, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT type, count(*) FROM edges GROUP BY 1"),
    "type_share": (type_share, f"WITH {NODES_SQL}, c AS (SELECT type, count(*) AS n FROM nodes GROUP BY 1) SELECT type, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS share, round(100.0::DOUBLE * n / max(n) OVER (), 4) AS relative FROM c"),
    "conditional_counts": (conditional_counts, "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS processed FROM orders GROUP BY 1"),
    "null_domain_counts": (null_domain_counts, f"WITH {NODES_SQL} SELECT coalesce(domain, 'atlas') AS domain, count(*) AS n FROM nodes GROUP BY 1"),
    "orphan_edges": (orphan_edges, f"WITH {EDGES_SQL} SELECT id FROM edges WHERE type = 'supplies' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND id = 'supplier#' || l_suppkey || '|supplies|part#' || l_partkey)"),
    "missing_customers": (missing_customers, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "drift_report": (drift_report, f"WITH {GRAPH_SQL} SELECT e.type, target_id, count(*) AS n FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE a.domain IS DISTINCT FROM b.domain GROUP BY 1, 2"),
    "upserted_suppliers": (upserted_suppliers, "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 99 ELSE s_nationkey END::BIGINT AS s_nationkey FROM supplier"),
    "keep_one_live_job": (keep_one_live_job, f"WITH {JOBS_SQL} SELECT paper_id, id FROM jobs QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY owner IS NULL, created_at, id) = 1"),
    "queue_position": (queue_position, f"WITH {JOBS_SQL} SELECT id, lane, row_number() OVER (PARTITION BY lane ORDER BY created_at, id) AS position FROM jobs WHERE owner IS NULL"),
    "claims": (claims, f"WITH {JOBS_SQL} SELECT id, lane FROM jobs WHERE owner IS NULL QUALIFY row_number() OVER (PARTITION BY lane ORDER BY created_at, id) <= 2"),
    "lane_depth": (lane_depth, f"WITH {JOBS_SQL} SELECT lane, count(*) FILTER (owner IS NULL) AS queued, count(*) FILTER (owner IS NOT NULL) AS running FROM jobs GROUP BY 1"),
    "rate_limit_fixed": (rate_limit_fixed, """SELECT user_id, count(*) FILTER (place <= 2) AS allowed, count(*) FILTER (place > 2) AS refused FROM
      (SELECT user_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts))::BIGINT // 86400 ORDER BY floor(epoch(ts)), event_id) AS place FROM events) GROUP BY 1"""),
    "error_runs": (error_runs, """SELECT user_id, max(n) AS longest FROM (SELECT user_id, run, count(*) FILTER (bad) AS n FROM (SELECT user_id, event_type = 'error' AS bad,
      sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM events) GROUP BY 1, 2) GROUP BY 1"""),
    "comentioned_parts": (comentioned_parts, """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey)
      SELECT a.l_partkey, b.l_partkey AS other, count(*) AS n FROM l a JOIN l b USING (l_orderkey, p_brand) WHERE a.l_partkey < b.l_partkey GROUP BY 1, 2"""),
    "previous_turns": (previous_turns, "SELECT conv_id, turn, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 200), '') AS overlap FROM conversations"),
}
