"""Findings about a finished graph (names that are none, nodes without edges, twins of one paper), and acting on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.domains import domain_is
from loomfield.functions.names import judge_connectivity, judge_name, judge_pair, survivor
from loomfield.functions.text import normalise_name
from loomfield.operators import graph
from loomfield.operators.maintenance import rewritten
from loomfield.sources.tables import staged

# How findings are listed.
CONFIDENCE = ["high", "medium", "low"]
PAGE = 500
# End of fixed values.


def name_cuts(names: DataFrame) -> DataFrame:
    """(long, name): names of (id, name) that begin or end with another one, and names of several ids with themselves.

    Every distinct name spells its beginnings and ends once, which meet the names by equality: as many rows as it has letters, twice,
    whatever the number of sources that mention it.
    """
    known = names.groupBy("name").agg((F.min("id") != F.max("id")).alias("shared"))
    n = F.length("name")
    cuts = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr("name", F.lit(1), i)), F.transform(F.sequence(F.lit(1), n), lambda i: F.substr("name", i, n))))
    spelt = known.select(F.col("name").alias("long"), F.explode(cuts).alias("name")).where("name <> long").join(known.select("name"), "name")
    return spelt.select("long", "name").unionByName(known.where("shared").select(F.col("name").alias("long"), "name"))


def co_mentioned(nodes: DataFrame, edges: DataFrame, chosen: Column) -> DataFrame:
    """(a, b): nodes, a < b, that one source mentions and of which one's name begins or ends with the other's; a is ``chosen``.

    The names that are a beginning or end of another are found first, by ``name_cuts``; only mentions of such names meet, by source and
    shorter name, so a source's other mentions are neither spelt nor paired.
    """
    names = nodes.select("id", normalise_name(F.col("name")).alias("name")).where("name <> ''")
    cuts = staged(name_cuts(names), "name-cuts")
    held = edges.where("type = 'mentions'").select("source_id", F.col("target_id").alias("id"))
    longs = held.join(names.withColumnRenamed("name", "long").join(cuts, "long").select("id", "name"), "id").distinct().withColumnRenamed("id", "long")
    shorts = held.join(names.join(cuts.select("name").distinct(), "name"), "id").distinct()
    pairs = longs.join(shorts, ["source_id", "name"]).where("long <> id").select(F.least("long", "id").alias("a"), F.greatest("long", "id").alias("b")).distinct()
    return pairs.join(nodes.where(chosen).select(F.col("id").alias("a")), "a", "left_semi").select("a", "b")


def audit(nodes: DataFrame, edges: DataFrame, domain: str) -> DataFrame:
    """(id, domain, node_id, related_id, detector, verdict, reason, confidence, status) proposed for one domain.

    One finding for a node, its name before its edges; one for a pair, whose node is the one that would go. Ids are
    hashes of what is found, so an audit that runs again proposes the same rows.
    """
    own = domain_is(F.col("domain"), domain)
    seen = graph.degrees(nodes.where(own).select("id", "name"), edges).withColumn("n", judge_name(F.col("name"))).withColumn("c", judge_connectivity(F.col("degree")))
    odd = F.col("n.verdict") != "keep"
    alone = seen.where(odd | (F.col("c.verdict") != "keep")).select(
        F.col("id").alias("node_id"), F.lit(None).cast("string").alias("related_id"), F.when(odd, "malformed-name").otherwise("orphan").alias("detector"), F.when(odd, F.col("n")).otherwise(F.col("c")).alias("j")
    )
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("name").alias(f"{x}_name"), F.col("type").alias(f"{x}_type"))
    pairs = co_mentioned(nodes, edges, own).join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.withColumn("j", judge_pair(F.col("a_name"), F.col("b_name"), F.col("a_type"), F.col("b_type"))).where("j.verdict <> 'keep'")
    merge, first = F.col("j.verdict") == "merge", survivor(F.col("a_name"), F.col("b_name")) == F.col("a_name")
    both = pairs.select(F.when(merge & first, F.col("b")).otherwise(F.col("a")).alias("node_id"), F.when(merge & ~first, F.col("b")).when(merge, F.col("a")).otherwise(F.col("b")).alias("related_id"), F.lit("duplicate-within-paper").alias("detector"), "j")
    found = alone.unionByName(both).select(F.lit(domain).alias("domain"), "node_id", "related_id", "detector", "j.verdict", "j.reason", "j.confidence", F.lit("proposed").alias("status"))
    key = F.concat_ws("\u0000", "domain", "node_id", F.coalesce("related_id", F.lit("")), "detector")
    return found.select(F.sha1(key.cast("binary")).alias("id"), "*")


def replaced(findings: DataFrame, new: DataFrame, domain: str) -> DataFrame:
    """The findings after an audit: a domain's proposals are replaced, what was applied or dismissed stays."""
    stale = (F.col("domain") == domain) & (F.col("status") == "proposed")
    return findings.where(~F.coalesce(stale, F.lit(False))).unionByName(new)


def dismissed(findings: DataFrame, ids: list[str]) -> DataFrame:
    """Proposals of these ids become dismissed; others are left."""
    return findings.withColumn("status", F.when(F.col("id").isin(*ids) & (F.col("status") == "proposed"), "dismissed").otherwise(F.col("status")) if ids else F.col("status"))


def listed(findings: DataFrame, limit: int | None = PAGE) -> DataFrame:
    """Surest first, then by detector and id; without a limit all of them."""
    place = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))
    rows = findings.orderBy(F.when(place == 0, len(CONFIDENCE) + 1).otherwise(place), "detector", "id")
    return rows if limit is None else rows.limit(limit)


def summary(findings: DataFrame) -> DataFrame:
    return findings.where("status = 'proposed'").groupBy("verdict", "confidence").agg(F.count("*").alias("n"))


def keepers(pairs: DataFrame) -> DataFrame:
    """(loser, keeper) with chains followed to their end, each round twice as far; ``pairs`` that name a ring raise."""
    held = staged(pairs.where("loser <> keeper").groupBy("loser").agg(F.min("keeper").alias("keeper")), "merges")
    for _ in range(64):
        step = held.select(F.col("loser").alias("keeper"), F.col("keeper").alias("next"))
        moved = staged(held.join(step, "keeper", "left").select("loser", F.coalesce("next", "keeper").alias("keeper")), "merges")
        if not moved.where("loser = keeper").isEmpty():
            break
        if moved.join(held, ["loser", "keeper"], "left_anti").isEmpty():
            return moved
        held = moved
    raise ValueError("the merges name each other in a ring")


def merged(tables: dict[str, DataFrame], mapping: DataFrame) -> dict[str, DataFrame]:
    """All tables of a graph after merging ``mapping`` (loser, keeper): the whole contraction.

    Edges move to the keepers; loops go; of repeated claims the earliest (created_at, where there is one, then id) stays
    and takes over the provenance of the others; evidence names the keepers, each once; losers and their vectors go.
    ``tables``: nodes, edges, and any of sources (edge_id), propositions (node_ids), node_vectors (id).
    """
    out = dict(tables)
    lost = mapping.select(F.col("loser").alias("id"))
    out["nodes"] = tables["nodes"].join(lost, "id", "left_anti")
    ends = lambda c: mapping.select(F.col("loser").alias(c), F.col("keeper").alias(f"new_{c}"))
    edges = tables["edges"]
    moved = edges.join(ends("source_id"), "source_id", "left").join(ends("target_id"), "target_id", "left")
    moved = moved.withColumn("source_id", F.coalesce("new_source_id", "source_id")).withColumn("target_id", F.coalesce("new_target_id", "target_id")).where("source_id <> target_id").select(*edges.columns)
    age = F.struct(*[F.col(c) for c in ("created_at", "id") if c in edges.columns])
    claim = ["source_id", "target_id", "type"]
    rest = F.struct(*[F.col(c) for c in edges.columns if c not in claim])  # the claim itself is the key of its group
    best = staged(moved.groupBy(*claim).agg(F.min_by(rest, age).alias("row")), "merged-edges")
    out["edges"] = best.select(*claim, "row.*").select(*edges.columns)
    if "sources" in tables:
        stays = best.select("source_id", "target_id", "type", F.col("row.id").alias("stays"))
        onto = moved.select("source_id", "target_id", "type", F.col("id").alias("edge_id")).join(stays, ["source_id", "target_id", "type"]).select("edge_id", "stays")
        columns = tables["sources"].columns
        out["sources"] = tables["sources"].join(onto, "edge_id").withColumn("edge_id", F.col("stays")).select(*columns)
    if "propositions" in tables:
        props = tables["propositions"]
        named = props.select("id", F.explode("node_ids").alias("loser")).join(mapping, "loser").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("loser", "keeper"))).alias("moves"))
        out["propositions"] = props.join(named, "id", "left").withColumn("node_ids", F.when(F.col("moves").isNull(), F.col("node_ids")).otherwise(F.array_sort(rewritten(F.col("node_ids"), F.col("moves"))))).select(*props.columns)
    if "node_vectors" in tables:
        out["node_vectors"] = tables["node_vectors"].join(lost, "id", "left_anti")
    return out


def dropped(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables of a graph without the nodes of ``ids`` (id): their edges, the provenance of those, and their vectors go too."""
    out = dict(tables)
    out["nodes"] = tables["nodes"].join(ids, "id", "left_anti")
    edges = reduce(lambda df, c: df.join(ids.withColumnRenamed("id", c), c, "left_anti"), ("source_id", "target_id"), tables["edges"])
    out["edges"] = edges.select(*tables["edges"].columns)
    if "sources" in tables:
        out["sources"] = tables["sources"].join(edges.select(F.col("id").alias("edge_id")), "edge_id", "left_semi")
    if "node_vectors" in tables:
        out["node_vectors"] = tables["node_vectors"].join(ids, "id", "left_anti")
    return out


def applied(tables: dict[str, DataFrame], findings: DataFrame, ids: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after acting on the proposals of ``ids``, and the findings with those marked applied.

    Merges and drops act; reviews, and what is not proposed any more, have no action and raise. A node that one finding
    merges and another drops is dropped.
    """
    asked = findings.where(F.col("id").isin(*ids)) if ids else findings.limit(0)
    act = (F.col("verdict") == "drop") | ((F.col("verdict") == "merge") & F.col("related_id").isNotNull())
    good = asked.agg(F.count_if(act & (F.col("status") == "proposed")).alias("n")).first()["n"]
    if good != len(set(ids)):
        raise ValueError(f"{len(set(ids)) - good} of the findings are unknown, not proposed, or have no action")
    drops = staged(asked.where("verdict = 'drop'").select(F.col("node_id").alias("id")).distinct(), "drops")
    merges = asked.where("verdict = 'merge'").select(F.col("node_id").alias("loser"), F.col("related_id").alias("keeper"))
    mapping = keepers(merges.join(drops.withColumnRenamed("id", "loser"), "loser", "left_anti"))
    out = dropped(merged(tables, mapping), drops)
    return out, findings.withColumn("status", F.when(F.col("id").isin(*ids), "applied").otherwise(F.col("status")) if ids else F.col("status"))


def identity_mapping(nodes: DataFrame) -> DataFrame:
    """(loser, keeper) of nodes of one domain and name in lower case; the earliest (created_at, where there is one, then id) stays.

    The keeper is summed before the shuffle and joined back, so a hot identity is split like any join.
    """
    keyed = nodes.withColumn("__d", F.coalesce("domain", F.lit(""))).withColumn("__n", normalise_name(F.col("name"))).where("__n is not null")
    age = F.struct(*[F.col(c) for c in ("created_at", "id") if c in nodes.columns])
    first = keyed.groupBy("__d", "__n").agg(F.min_by("id", age).alias("keeper"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(first, ["__d", "__n"]).where("id <> keeper").select(F.col("id").alias("loser"), "keeper")


def ranked_edges(edges: DataFrame) -> DataFrame:
    """Edges with ``keeper``, the earliest claim of their ends and type."""
    age = [c for c in ("created_at", "id") if c in edges.columns]
    return edges.withColumn("keeper", F.first("id").over(Window.partitionBy("source_id", "target_id", "type").orderBy(*age)))
