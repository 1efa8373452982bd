"""Graph operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.domains import domain_is
from loomfield.functions.text import ROLE_ORDER
from loomfield.operators import graph as g
from loomfield.plans.views import GRAPH_SQL, edges, nodes, pages
from loomfield.sources.tables import staged, table

SEED, RESTART, ROUNDS, LPA_ROUNDS = "region#1", 0.15, 30, 10
KINDS_OF_CLAIMS = ["introduces", "extends", "uses", "evaluates_on", "compares_to", "mentions"]


def hubs(spark: SparkSession, sf: str) -> DataFrame:
    return g.hubs(nodes(spark, sf), edges(spark, sf), 50).select("id", "name", "degree")


def degree_of_all(spark: SparkSession, sf: str) -> DataFrame:
    return g.degrees(nodes(spark, sf), edges(spark, sf)).select("id", "degree")


def subgraph_2(spark: SparkSession, sf: str) -> DataFrame:
    inside, _ = g.subgraph(nodes(spark, sf), staged(edges(spark, sf), "edges"), nodes(spark, sf).where(F.col("id") == SEED), 2)
    return inside.select("id", F.col("hop").cast("long").alias("hop"))


def subgraph_2_edges(spark: SparkSession, sf: str) -> DataFrame:
    _, kept = g.subgraph(nodes(spark, sf), staged(edges(spark, sf), "edges"), nodes(spark, sf).where(F.col("id") == SEED), 2)
    return kept.select("id")


def ppr_region(spark: SparkSession, sf: str) -> DataFrame:
    seeds = nodes(spark, sf).where(F.col("id") == SEED).select("id", F.lit(1.0).alias("weight"))
    return g.personalized_pagerank(nodes(spark, sf), edges(spark, sf), seeds, RESTART, ROUNDS).select("id", F.round("mass", 6).alias("mass"))


def label_groups(spark: SparkSession, sf: str) -> DataFrame:
    return g.label_propagation(nodes(spark, sf), edges(spark, sf), rounds=LPA_ROUNDS)


def community_titles(spark: SparkSession, sf: str) -> DataFrame:
    every = nodes(spark, sf)
    return g.communities(every, g.label_propagation(every, edges(spark, sf), rounds=LPA_ROUNDS))


def _varied(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose types stand for every role: supplies edges take one of six kinds by the length of their id."""
    kinds = F.array(*map(F.lit, KINDS_OF_CLAIMS))
    return edges(spark, sf).withColumn("type", F.when(F.col("type") == "supplies", F.get(kinds, F.substring_index("target_id", "#", -1).cast("int") % len(KINDS_OF_CLAIMS))).otherwise(F.col("type")))


def node_detail(spark: SparkSession, sf: str) -> DataFrame:
    return g.neighbours(nodes(spark, sf), _varied(spark, sf), "part#3").select("direction", "role", "type", "peer_id", "peer_name", "peer_type")


def lens_roles(spark: SparkSession, sf: str) -> DataFrame:
    return g.lens(nodes(spark, sf), _varied(spark, sf), "supplier#3")


def compare_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return g.compare(edges(spark, sf), "supplier#1", "supplier#2")


def in_domain_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with both ends in the default domain, which also owns the nodes without one."""
    return g.within_domain(nodes(spark, sf), edges(spark, sf), domain_is(F.col("domain"), "default")).select("id")


def contradicting_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers 'improve' parts, and every tenth part improves its suppliers: low confidence, temporal order (the length of a
    name stands in for a date) and claims both ways."""
    claims = edges(spark, sf).withColumn("type", F.when(F.col("type") == "supplies", "improves").otherwise(F.col("type")))
    claims = claims.withColumn("confidence", F.col("confidence") - 0.45).select("id", "source_id", "target_id", "type", "confidence")
    tenth = claims.where((F.col("type") == "improves") & (F.substring_index("target_id", "#", -1).cast("int") % 10 == 0))
    back = tenth.select(F.concat(F.lit("back|"), "id").alias("id"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "type", F.lit(0.9).alias("confidence"))
    dates = nodes(spark, sf).select("id", F.length("name").alias("date"))
    return g.contradictions(claims.unionByName(back), dates)


def contraction(spark: SparkSession, sf: str) -> DataFrame:
    """All suppliers of a nation become one; edges move, repeated ones and loops go."""
    at = table(spark, sf, "supplier").select(F.concat(F.lit("supplier#"), "s_suppkey").alias("loser"), F.col("s_nationkey").alias("nation"))
    least = at.groupBy("nation").agg(F.min("loser").alias("keeper"))
    mapping = at.join(least, "nation").where("loser <> keeper").select("loser", "keeper")
    _, kept = g.contract(nodes(spark, sf), edges(spark, sf), mapping)
    return kept.select("id", "source_id", "target_id", "type")


def identity_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return g.duplicates(nodes(spark, sf))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).groupBy("target_id").agg(F.count("*").alias("n"))


def _ppr_sql() -> str:
    steps = [f"""r0 AS MATERIALIZED (SELECT id, CASE WHEN id = '{SEED}' THEN 1.0::DOUBLE ELSE 0 END AS mass FROM nodes)"""]
    for i in range(ROUNDS):
        steps.append(f"""r{i + 1} AS MATERIALIZED (SELECT n.id, {RESTART} * s.mass + {1 - RESTART} * coalesce(m.mass, 0)
          + {1 - RESTART} * s.mass * (SELECT coalesce(sum(mass), 0) FROM r{i} WHERE id NOT IN (SELECT node FROM steps)) AS mass
          FROM nodes n JOIN r0 s USING (id) LEFT JOIN (SELECT t.peer AS id, sum(r.mass * t.share) AS mass FROM r{i} r JOIN steps t ON r.id = t.node GROUP BY 1) m USING (id))""")
    return f"""WITH {GRAPH_SQL}, steps AS MATERIALIZED (SELECT node, peer, w / sum(w) OVER (PARTITION BY node) AS share FROM
      (SELECT node, peer, sum(CASE WHEN w > 0 THEN w ELSE 0.01 END) AS w FROM walk WHERE node <> peer GROUP BY 1, 2)), {', '.join(steps)}
      SELECT id, round(mass, 6) AS mass FROM r{ROUNDS}"""


def _lpa_sql(tail: str) -> str:
    steps = ["both_ways AS MATERIALIZED (SELECT node AS a, peer AS b FROM walk WHERE node <> peer)", "l0 AS (SELECT id, id AS label FROM nodes)"]
    for i in range(LPA_ROUNDS):
        steps.append(f"""l{i + 1} AS MATERIALIZED (SELECT l.id, coalesce(v.label, l.label) AS label FROM l{i} l LEFT JOIN (SELECT a, label FROM
          (SELECT a, label, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, label) AS place FROM both_ways JOIN l{i} ON b = id GROUP BY a, label) WHERE place = 1) v ON v.a = l.id)""")
    return f"WITH {GRAPH_SQL}, {', '.join(steps)} {tail.replace('$L', f'l{LPA_ROUNDS}')}"


HOP_SQL = f"""WITH {GRAPH_SQL}, h0 AS (SELECT '{SEED}' AS id, 0 AS hop), h1 AS MATERIALIZED (SELECT DISTINCT peer AS id, 1 AS hop FROM walk JOIN h0 ON node = id),
 h2 AS MATERIALIZED (SELECT DISTINCT peer AS id, 2 AS hop FROM walk JOIN h1 ON node = id), reached AS MATERIALIZED (SELECT id, min(hop)::BIGINT AS hop FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2) GROUP BY id)"""
VARIED_SQL = f"""varied AS MATERIALIZED (SELECT id, source_id, target_id, CASE WHEN type = 'supplies' THEN ['{"', '".join(KINDS_OF_CLAIMS)}'][split_part(target_id, '#', 2)::INT % {len(KINDS_OF_CLAIMS)} + 1] ELSE type END AS type FROM edges)"""
OUT_SQL = "CASE s.type WHEN 'introduces' THEN 'contributes' WHEN 'extends' THEN 'builds_on' WHEN 'uses' THEN 'uses' WHEN 'evaluates_on' THEN 'validated_on' WHEN 'compares_to' THEN 'compared_with' ELSE 'covers' END"
ROLE_SQL = f"CASE WHEN s.direction = 'in' AND s.type = 'introduces' THEN 'builds_on' WHEN s.direction = 'in' AND s.type = 'extends' THEN 'contributes' ELSE {OUT_SQL} END"
SEEN_SQL = f"""seen AS (SELECT 'out' AS direction, type, source_id AS me, target_id AS peer_id FROM varied UNION ALL SELECT 'in', type, target_id, source_id FROM varied WHERE source_id <> target_id)"""

QUERIES = {
    "hubs": (hubs, f"WITH {GRAPH_SQL} SELECT id, name, count(*) AS degree FROM nodes JOIN walk ON node = id GROUP BY 1, 2 ORDER BY degree DESC, name, id LIMIT 50"),
    "degree_of_all": (degree_of_all, f"WITH {GRAPH_SQL} SELECT id, count(peer) AS degree FROM nodes LEFT JOIN walk ON node = id GROUP BY 1"),
    "subgraph_2": (subgraph_2, f"{HOP_SQL} SELECT id, hop FROM reached"),
    "subgraph_2_edges": (subgraph_2_edges, f"{HOP_SQL} SELECT id FROM edges WHERE source_id IN (SELECT id FROM reached) AND target_id IN (SELECT id FROM reached)"),
    "ppr_region": (ppr_region, _ppr_sql()),
    "label_groups": (label_groups, _lpa_sql("SELECT id, label FROM $L")),
    "community_titles": (community_titles, _lpa_sql("""SELECT label, count(*) AS size, string_agg(name, ', ' ORDER BY name, id) FILTER (place <= 3) AS title FROM
      (SELECT label, name, id, row_number() OVER (PARTITION BY label ORDER BY name, id) AS place FROM $L JOIN nodes USING (id)) GROUP BY label HAVING count(*) >= 3""")),
    "node_detail": (node_detail, f"WITH {GRAPH_SQL}, {VARIED_SQL}, {SEEN_SQL} SELECT direction, {ROLE_SQL} AS role, s.type, peer_id, name AS peer_name, n.type AS peer_type FROM seen s JOIN nodes n ON n.id = peer_id WHERE me = 'part#3'"),
    "lens_roles": (lens_roles, f"WITH {GRAPH_SQL}, {VARIED_SQL}, {SEEN_SQL}, r AS (SELECT {ROLE_SQL} AS role FROM seen s WHERE me = 'supplier#3') SELECT role, count(*) AS n, list_position({ROLE_ORDER}, role) AS place FROM r GROUP BY 1"),
    "compare_suppliers": (compare_suppliers, f"""WITH {GRAPH_SQL}, a AS (SELECT DISTINCT target_id AS id FROM edges WHERE source_id = 'supplier#1'), b AS (SELECT DISTINCT target_id AS id FROM edges WHERE source_id = 'supplier#2')
      SELECT id, CASE WHEN a.id IS NULL THEN 'only_b' WHEN b.id IS NULL THEN 'only_a' ELSE 'shared' END AS side FROM a FULL JOIN b USING (id)"""),
    "in_domain_edges": (in_domain_edges, f"WITH {GRAPH_SQL} SELECT e.id FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE coalesce(a.domain, 'default') = 'default' AND coalesce(b.domain, 'default') = 'default'"),
    "contradicting_orders": (contradicting_orders, f"""WITH {GRAPH_SQL} SELECT id, 'low_confidence' AS reason FROM edges WHERE confidence - 0.45 <= 0.5
      UNION ALL SELECT e.id, 'temporal' FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE e.type = 'supplies' AND length(a.name) < length(b.name)
      UNION ALL SELECT 'back|' || e.id, 'temporal' FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE e.type = 'supplies' AND split_part(target_id, '#', 2)::INT % 10 = 0 AND length(a.name) > length(b.name)
      UNION ALL SELECT unnest([id, 'back|' || id]), 'mutual' FROM edges WHERE type = 'supplies' AND split_part(target_id, '#', 2)::INT % 10 = 0"""),
    "contraction": (contraction, f"""WITH {GRAPH_SQL}, moves AS (SELECT 'supplier#' || s_suppkey AS loser, min('supplier#' || s_suppkey) OVER (PARTITION BY s_nationkey) AS keeper FROM supplier)
      SELECT min(id) AS id, source_id, target_id, type FROM (SELECT e.id, coalesce(a.keeper, source_id) AS source_id, coalesce(b.keeper, target_id) AS target_id, type FROM edges e LEFT JOIN moves a ON a.loser = source_id LEFT JOIN moves b ON b.loser = target_id)
      WHERE source_id <> target_id GROUP BY 2, 3, 4"""),
    "identity_duplicates": (identity_duplicates, f"WITH {GRAPH_SQL} SELECT id AS loser, keeper FROM (SELECT id, min(id) OVER (PARTITION BY coalesce(domain, ''), lower(trim(name))) AS keeper FROM nodes) WHERE id <> keeper"),
    "page_links": (page_links, """SELECT target_id, count(*) AS n FROM (SELECT DISTINCT url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target_id FROM pages) GROUP BY 1"""),
}
