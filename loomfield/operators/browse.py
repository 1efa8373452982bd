"""Looking into a graph: pages, lookups, papers, questions by name, and where a claim comes from."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.text import inverted, is_uuid, normalise_name, role
from loomfield.operators import graph

# The longest page of a listing, how many mentions a node shows, how many nodes a name may match.
PAGE, MENTIONS, MATCHES = 500, 6, 5
# End of fixed values.


def bounded(value, default: int, least: int = 1, most: int = PAGE) -> int:
    """A number asked for by a caller, kept between ``least`` and ``most``; what is no number is the default."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return default
    return default if number != number else int(min(max(number, least), most))


def page(rows: DataFrame, order: list, limit=50, offset=0, most: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """One page in a total order, and (total), the number of all rows."""
    return rows.orderBy(*order).offset(bounded(offset, 0, 0, 1 << 31)).limit(bounded(limit, 50, 1, most)), rows.agg(F.count("*").alias("total"))


def search(nodes: DataFrame, text: str | None = None, kind: str | None = None) -> DataFrame:
    """Nodes of a type whose name holds a text, whatever its case; nothing asked for keeps all. Wildcards in the text are letters."""
    found = nodes if kind is None else nodes.where(F.col("type") == kind)
    return found if not text else found.where(F.contains(F.lower("name"), F.lower(F.lit(text))))


def lookup(rows: DataFrame, ids: list[str], strict: bool = False) -> DataFrame:
    """Rows of these ids; with ``strict``, what is no uuid is not found instead of an error."""
    found = rows.where(F.col("id").isin(*ids)) if ids else rows.limit(0)
    return found.where(is_uuid(F.col("id"))) if strict else found


def probe(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, id): the node of each name in lower case, the smallest id where several share it."""
    first = nodes.groupBy(normalise_name(F.col("name")).alias("key")).agg(F.min("id").alias("id"))
    return names.select("name", normalise_name(F.col("name")).alias("key")).distinct().join(first, "key").select("name", "id")


def types(nodes: DataFrame) -> DataFrame:
    return nodes.select("type").distinct().orderBy("type")


def named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with source_name, source_type, target_name and target_type; edges without an end drop out."""
    side = lambda s: nodes.select(F.col("id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"), F.col("type").alias(f"{s}_type"))
    return edges.join(side("source"), "source_id").join(side("target"), "target_id")


def pointing_at(edges: DataFrame, nodes: DataFrame, kind: str, patterns: list[str]) -> DataFrame:
    """Edges of one type whose target's name matches one of the patterns, whatever its case."""
    return named(edges.where(F.col("type") == kind), nodes).where(reduce(or_, [F.col("target_name").ilike(p) for p in patterns]))


def datasets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(dataset, used_by, confidence) of evaluations on datasets."""
    used = named(edges.where("type = 'evaluates_on'"), nodes).where("target_type = 'dataset'")
    return used.select(F.col("target_name").alias("dataset"), F.col("source_name").alias("used_by"), "confidence")


def relationships(edges: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(direction, method, relationship, peer, peer_type, confidence) of up to MATCHES nodes whose name holds ``name``, by name and id."""
    chosen = search(nodes, name).orderBy("name", "id").limit(MATCHES).select("id")
    full = named(edges, nodes)
    out = full.join(chosen.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.lit("out").alias("direction"), F.col("source_name").alias("method"), F.col("type").alias("relationship"), F.col("target_name").alias("peer"), F.col("target_type").alias("peer_type"), "confidence")
    into = full.join(chosen.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.lit("in").alias("direction"), F.col("target_name").alias("method"), F.col("type").alias("relationship"), F.col("source_name").alias("peer"), F.col("source_type").alias("peer_type"), "confidence")
    return out.unionByName(into)


def provenance(edges: DataFrame, nodes: DataFrame, sources: DataFrame, papers: DataFrame, edge: str, chosen: Column | None = None) -> DataFrame:
    """(source_name, type, target_name, title, section, text): what supports an edge; of a domain that is not ``chosen``, nothing."""
    own = edges.where(F.col("id") == edge)
    own = named(own if chosen is None else own.where(chosen), nodes).select(F.col("id").alias("edge_id"), "source_name", "type", "target_name")
    return own.join(sources, "edge_id").join(papers.select(F.col("id").alias("paper_id"), "title"), "paper_id").select("source_name", "type", "target_name", "title", "section", "text")


def papers(nodes: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, name, domain, concepts, relationships, rank) of nodes that are documents themselves, not works that documents cite.

    A document's node carries its own paper and its title in lower case. ``nodes``: (id, name, type, domain, paper_id),
    ``documents``: (id, title). A paper without edges ranks like one with one edge.
    """
    own = documents.select(F.col("id").alias("paper_id"), F.lower("title").alias("key"))
    kept = nodes.where("type = 'paper'").withColumn("key", normalise_name(F.col("name"))).join(own, ["paper_id", "key"], "left_semi").select("id", "name", "domain")
    seen = kept.join(edges.select(F.col("source_id").alias("id"), F.col("type").alias("kind")), "id", "left").groupBy("id", "name", "domain")
    counted = seen.agg(F.count_if(F.col("kind") == "mentions").alias("concepts"), F.count_if(F.col("kind") != "mentions").alias("relationships"), F.count("*").alias("rank"))
    return counted.orderBy(F.desc("rank"), "name", "id")


def mentioning(propositions: DataFrame, node: str, limit: int = MENTIONS) -> DataFrame:
    """Up to ``limit`` pieces of evidence that name a node, smallest ids first."""
    return propositions.where(F.array_contains("node_ids", node)).orderBy("id").limit(limit)


def mentioning_any(propositions: DataFrame, ids: list[str]) -> DataFrame:
    return propositions.where(F.arrays_overlap("node_ids", F.array(*map(F.lit, ids)))) if ids else propositions.limit(0)


def lens_rows(nodes: DataFrame, edges: DataFrame, sources: DataFrame, node: str) -> DataFrame:
    """(role, place, phrase, peer_id, peer_name, edge_id, evidence): a node's edges by role, an incoming phrase turned round, with the
    first evidence (by paper and chunk) of each edge."""
    first = sources.where("text is not null").groupBy(F.col("edge_id")).agg(F.min_by("text", F.struct("paper_id", "chunk_index")).alias("evidence"))
    out = edges.where(F.col("source_id") == node).select(F.col("id").alias("edge_id"), "type", F.col("target_id").alias("peer_id"), F.lit(False).alias("incoming"))
    into = edges.where((F.col("target_id") == node) & (F.col("source_id") != node)).select(F.col("id").alias("edge_id"), "type", F.col("source_id").alias("peer_id"), F.lit(True).alias("incoming"))
    seen = out.unionByName(into).join(nodes.select(F.col("id").alias("peer_id"), F.col("name").alias("peer_name")), "peer_id").join(first, "edge_id", "left")
    roles = seen.withColumn("role", role(F.col("type"), F.col("incoming")))
    order = F.array_position(F.array(*map(F.lit, graph.ROLE_ORDER)), F.col("role"))
    phrase = F.when(F.col("incoming"), inverted(F.col("type"))).otherwise(F.regexp_replace("type", "_", " "))
    return roles.select("role", order.cast("long").alias("place"), phrase.alias("phrase"), "peer_id", "peer_name", "edge_id", "evidence")


def newest(rows: DataFrame, limit=50, offset=0, most: int = 200) -> DataFrame:
    return page(rows, [F.desc("created_at"), "id"], limit, offset, most)[0]


def firsts(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key, in the order given."""
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__place = 1").drop("__place")


def lasts(tables: list[DataFrame], key: str) -> DataFrame:
    """One row for each key out of several tables: that of the last table which has it."""
    told = reduce(DataFrame.unionByName, [df.withColumn("__turn", F.lit(i)) for i, df in enumerate(tables)])
    columns = tables[0].columns
    return told.groupBy(key).agg(F.max_by(F.struct(*columns), "__turn").alias("row")).select("row.*")


def domains_used(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, domain): every domain that a table has rows of."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("name"), "domain").distinct() for name, df in tables.items()])


def by_type_then_id(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("type", "id")
