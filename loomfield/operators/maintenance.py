"""Changes of stored tables as rewrites: new state = f(state, change)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.sources.tables import dealt


def insert_new(state: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``state`` and the rows whose key it lacks (one for each key)."""
    return state.unionByName(rows.dropDuplicates(key).join(state.select(*key), key, "left_anti").select(*state.columns))


def upsert(state: DataFrame, rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the greatest version for each key; of equal versions the one with the smallest hash, whatever the order of rows."""
    order = Window.partitionBy(*key).orderBy(F.desc(version), F.xxhash64(*state.columns))
    return state.unionByName(rows).withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


def orphans(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges that no source supports."""
    return edges.join(sources.select(F.col("edge_id").alias("id")), "id", "left_anti")


def clear_paper(edges: DataFrame, sources: DataFrame, paper: str, keep_chunks: list[int] = ()) -> tuple[DataFrame, DataFrame]:
    """Edges and sources without a paper's claims; claims of kept chunks and of other papers stay, those without a chunk go."""
    chunk_kept = F.coalesce(F.col("chunk_index").isin(*keep_chunks), F.lit(False)) if keep_chunks else F.lit(False)
    gone = (F.col("paper_id") == paper) & ~chunk_kept
    left, lost = sources.where(~F.coalesce(gone, F.lit(False))), sources.where(gone).select("edge_id").distinct()
    bare = lost.join(left.select("edge_id"), "edge_id", "left_anti").select(F.col("edge_id").alias("id"))
    return edges.join(bare, "id", "left_anti"), left


def missing_mentions(propositions: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, target_id): nodes a paper's propositions name without a mention edge."""
    named = propositions.select(F.col("paper_id").alias("source_id"), F.explode("node_ids").alias("target_id")).distinct()
    return named.join(edges.where("type = 'mentions'").select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")


def drifted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose domain differs from their source's; nulls compare as values."""
    at = nodes.select(F.col("id").alias("source_id"), F.col("domain").alias("source_domain"))
    return edges.join(at, "source_id").where(~F.col("domain").eqNullSafe(F.col("source_domain")))


def adopt(df: DataFrame, domain: str) -> DataFrame:
    """Rows without a domain join ``domain``."""
    return df.withColumn("domain", F.coalesce("domain", F.lit(domain)))


def rewritten(ids: Column, mapping: Column) -> Column:
    """An array of ids through a map of merged ones, each id once, the rest unchanged."""
    return F.array_distinct(F.transform(ids, lambda x: F.coalesce(F.try_element_at(mapping, x), x)))


def backfilled(edges: DataFrame, propositions: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``edges`` (id, source_id, target_id, type, domain, confidence) with the mentions that propositions name and that lack, and a source
    (edge_id, paper_id, section) for each of the new ones. ``propositions``: (paper_id, paper_node, section, domain, node_ids).
    ``parts``: tasks among which named nodes meet mentions; None leaves it to Spark."""
    pair = ["paper_node", "target_id"]
    named = propositions.select("paper_id", "paper_node", "section", "domain", F.explode("node_ids").alias("target_id")).where("paper_node <> target_id")
    pairs = dealt(named, parts, *pair).groupBy(*pair).agg(F.min(F.struct("paper_id", "section", "domain")).alias("r"))
    held = edges.where("type = 'mentions'").select(F.col("source_id").alias("paper_node"), "target_id")
    new = pairs.join(dealt(held, parts, *pair), pair, "left_anti")
    own = F.sha1(F.concat_ws("\u0000", "paper_node", F.lit("mentions"), "target_id").cast("binary"))
    written = new.select(own.alias("id"), F.col("paper_node").alias("source_id"), "target_id", F.lit("mentions").alias("type"), "r.domain", F.lit(1.0).alias("confidence"))
    return edges.select(*written.columns).unionByName(written), new.select(own.alias("edge_id"), "r.paper_id", "r.section")


def without_vector(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes that no vector stands for."""
    return nodes.join(vectors.where("vector is not null").select("id"), "id", "left_anti")


def moved_paper(tables: dict[str, DataFrame], paper: str, target: str) -> dict[str, DataFrame]:
    """All tables after a paper moves to another domain: its claims go, then the nodes it alone made and that no edge holds any
    more, and the paper waits to be processed again. ``tables``: papers(id, domain, status), nodes(id, paper_id, domain), edges, sources."""
    out = dict(tables)
    papers = tables["papers"]
    here = F.col("id") == paper
    was = papers.where(here & (F.coalesce("domain", F.lit("")) != target)).select(F.col("id").alias("paper_id"), F.coalesce("domain", F.lit("")).alias("__was"))
    moves = not was.isEmpty()
    if not moves:
        return out
    out["edges"], out["sources"] = clear_paper(tables["edges"], tables["sources"], paper)
    held = out["edges"].select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    made = tables["nodes"].join(F.broadcast(was), "paper_id").where(F.coalesce("domain", F.lit("")) == F.col("__was")).select("id")  # one paper
    out["nodes"] = tables["nodes"].join(made.join(held, "id", "left_anti"), "id", "left_anti")
    out["papers"] = papers.withColumn("domain", F.when(here, target).otherwise(F.col("domain"))).withColumn("status", F.when(here, "pending").otherwise(F.col("status")))
    return out


def repaired(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without those whose domain is not that of their source."""
    return edges.join(drifted(edges, nodes).select("id"), "id", "left_anti")


def repaired_evidence(propositions: DataFrame, papers: DataFrame) -> DataFrame:
    """Propositions (paper_id, domain) without those whose domain is not that of their paper (id, domain)."""
    at = papers.select(F.col("id").alias("paper_id"), F.col("domain").alias("__domain"))
    return propositions.join(at, "paper_id", "left").where(F.col("domain").eqNullSafe(F.col("__domain")) | F.col("paper_id").isNull()).select(*propositions.columns)


def drift_by_title(papers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(title, paper_domain, node_domain, nodes, connected): nodes of papers that sit in another domain, by the first 44 letters of the
    title. ``papers``: (id, title, domain); ``nodes``: (id, paper_id, domain, connected)."""
    at = papers.select(F.col("id").alias("paper_id"), F.left("title", F.lit(44)).alias("title"), F.col("domain").alias("paper_domain"))
    odd = nodes.join(at, "paper_id").where(~F.col("domain").eqNullSafe(F.col("paper_domain")))
    return odd.groupBy("title", "paper_domain", F.col("domain").alias("node_domain")).agg(F.count("*").alias("nodes"), F.count_if("connected").alias("connected"))


def null_domains(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, unowned) of every table, before adoption."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.count_if(F.col("domain").isNull()).alias("unowned")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, isolated nodes, edges for each node, percent isolated."""
    held = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().withColumn("on", F.lit(True))
    seen = nodes.select("id").join(held, "id", "left").agg(F.count("*").alias("nodes"), F.count_if(F.col("on").isNull()).alias("isolated"))
    both = seen.join(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row each
    return both.select("nodes", "edges", "isolated", F.try_divide("edges", "nodes").alias("edges_per_node"), (100 * F.try_divide("isolated", "nodes")).alias("percent_isolated"))


def usage(log: DataFrame) -> DataFrame:
    """(mode, operation, calls, tokens, latency, models) of a usage log (mode, operation, tokens, latency, model); operation is null in the
    totals of a mode."""
    sums = log.rollup("mode", "operation").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("latency").alias("latency"), F.array_sort(F.collect_set("model")).alias("models"))
    return sums.where("mode is not null")
