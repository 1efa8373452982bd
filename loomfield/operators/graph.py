"""Graph operators over nodes(id, ...) and edges(source_id, target_id, type, confidence, ...)."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.text import ROLE_ORDER, role
from loomfield.operators import blocks
from loomfield.sources.tables import staged

#: Rounds of a walk between two written tables.
STAGE_EVERY = 5


def ends(edges: DataFrame, *keep: str) -> DataFrame:
    """Each edge once from either end, as (node, peer, ...), in one pass over the edges; a loop appears once."""
    way = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("peer"))
    out, back = way("source_id", "target_id"), way("target_id", "source_id")
    both = edges.select(F.explode(F.when(F.col("source_id") != F.col("target_id"), F.array(out, back)).otherwise(F.array(out))).alias("way"), *keep)
    return both.select("way.node", "way.peer", *keep)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes with their number of edges at either end; 0 for isolated ones."""
    counted = ends(edges).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.join(counted, "id", "left").fillna(0, ["degree"])


def hubs(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """The nodes of highest degree, none isolated; ties by name, then id."""
    return degrees(nodes, edges).where("degree > 0").orderBy(F.desc("degree"), "name", "id").limit(limit)


def expand(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(id, hop) of every node within ``hops`` steps of the seeds, edges taken in both directions.

    Each step joins only the newest nodes, and leaves out those seen before by an anti join.
    """
    walk = ends(edges)
    seen = frontier = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        reached = frontier.join(walk, frontier["id"] == walk["node"]).select(F.col("peer").alias("id")).distinct()
        frontier = reached.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        frontier = staged(frontier, "expand")
        seen = seen.unionByName(frontier)
    return seen


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` steps, and the edges with both ends among them."""
    inside = nodes.join(expand(seeds, edges, hops), "id")
    ids = inside.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return inside, kept.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def within_domain(nodes: DataFrame, edges: DataFrame, chosen: Column) -> DataFrame:
    """Edges whose two ends both satisfy ``chosen``: traversal never leaves the domain.

    The ids shuffle: by the size of their compressed files they would be broadcast, and every task would hold all of them.
    """
    for end in ("source_id", "target_id"):
        edges = edges.join(nodes.where(chosen).select(F.col("id").alias(end)).hint("shuffle_hash"), end, "left_semi")
    return edges


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, restart: float = 0.15, rounds: int = 30) -> DataFrame:
    """(id, mass) after a fixed number of rounds; the masses add up to 1.

    Edges count in both directions, parallel ones add up, loops drop out, weights of 0 or less count 0.01. ``seeds`` has
    (id, weight); without usable seeds every node is one. Mass of nodes without edges returns to the seeds. Such nodes
    only ever hold what the seeds give them, so their total follows a recurrence on one number.
    """
    ids = staged(nodes.select("id").distinct().withColumn("n", F.monotonically_increasing_id()), "ppr-ids")  # rounds join numbers, not names
    weight = F.coalesce(F.col("confidence").cast("double"), F.lit(0.5))
    links = blocks.numbered(ids, edges, F.when(weight > 0, weight).otherwise(0.01))
    start = ids.select("n", F.lit(1.0).alias("w"))
    if seeds is not None:
        usable = seeds.where("weight > 0").groupBy("id").agg(F.sum("weight").alias("w")).join(ids, "id").select("n", "w")
        start = usable if not usable.isEmpty() else start
    total = start.agg(F.sum("w")).first()[0]
    start = staged(start.select("n", (F.col("w") / F.lit(total or 1.0)).alias("s")), "ppr-seeds")
    held = blocks.degrees(links)
    alone = start.join(held, "n", "left_anti")
    idle = alone.agg(F.sum("s")).first()[0] or 0.0
    given, rest = [], idle
    for _ in range(rounds):
        given.append(restart + (1 - restart) * rest)
        rest = idle * given[-1]
    walk = _mass_by_rows if blocks.crowded(held, blocks.LINKS) else _mass_by_blocks
    mass = walk(links, start, restart, given).unionByName(alone.select("n", (F.col("s") * (given[-1] if given else 1.0)).alias("mass")))
    return ids.join(mass.hint("shuffle_hash"), "n", "left").select("id", F.coalesce("mass", F.lit(0.0)).alias("mass"))


def _mass_by_blocks(links: DataFrame, start: DataFrame, restart: float, given: list[float]) -> DataFrame:
    """(n, mass) of nodes with links: a node sends its mass for one unit of its links' weight."""

    def first(block):
        return block[4] / np.add.reduceat(block[3], block[1]) if block[4] is not None else np.zeros(len(block[0]))

    def step(block, received, old, turn):
        _, starts, places, weights, s = block
        mass = (1 - restart) * np.add.reduceat(weights * received[places], starts) + (0.0 if s is None else s * given[turn - 1])
        return mass / np.add.reduceat(weights, starts)

    def finish(block, received, old):
        return old * np.add.reduceat(block[3], block[1])

    return blocks.Blocks(links, start).run(first, step, finish, "float64", len(given)).toDF("n", "mass")


def _mass_by_rows(links: DataFrame, start: DataFrame, restart: float, given: list[float]) -> DataFrame:
    """The same where a node has more links than a block: its links are rows like any others."""
    pairs = staged(blocks.both_ways(links).groupBy("a", "b").agg(F.sum("w").alias("w")), "ppr-pairs")
    sums = pairs.groupBy("a").agg(F.sum("w").alias("total"))
    steps = staged(pairs.join(sums, "a").select("a", "b", (F.col("w") / F.col("total")).alias("share")), "ppr-steps")
    start = start.join(sums.select(F.col("a").alias("n")), "n", "left_semi")
    steps = steps.repartition("a").persist(StorageLevel.MEMORY_AND_DISK)  # its lineage is a written table
    mass = start.select("n", F.col("s").alias("mass"))
    for turn, part in enumerate(given, 1):
        moved = steps.join(mass, mass["n"] == steps["a"]).select(F.col("b").alias("n"), (F.col("mass") * F.col("share") * (1 - restart)).alias("mass"))
        mass = moved.unionByName(start.select("n", (F.col("s") * part).alias("mass"))).groupBy("n").agg(F.sum("mass").alias("mass"))
        if turn % STAGE_EVERY == 0 or turn == len(given):
            mass = staged(mass, "ppr-mass")
    steps.unpersist()
    return mass


def forward_push(edges: DataFrame, seeds: DataFrame, restart: float = 0.15, bound: float = 1e-4, rounds: int = 200) -> DataFrame:
    """(query_id, id, mass, residual): Personalized PageRank of many questions at once, touching only nodes that still hold much.

    ``seeds``: (query_id, id, weight), weights above 0; edges count as in ``personalized_pagerank``. A node whose residual
    exceeds ``bound`` times its number of neighbours keeps ``restart`` of it as mass and hands the rest on along its
    edges; all such nodes of all questions move in one join and one aggregation. Masses are below the true ones, by the sum
    of a question's residuals in all. A node without edges hands its rest to the question's seeds. A hub's edges are
    rows like any others, and the join's skew handling splits them.
    """
    weight = F.coalesce(F.col("confidence").cast("double"), F.lit(0.5))
    walk = ends(edges.where("source_id <> target_id").withColumn("w", F.when(weight > 0, weight).otherwise(0.01)), "w")
    pairs = staged(walk.groupBy("node", "peer").agg(F.sum("w").alias("w")), "push-pairs")
    sums = pairs.groupBy("node").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("peers"))
    steps = staged(pairs.join(sums, "node").select("node", "peer", (F.col("w") / F.col("total")).alias("share")), "push-steps")
    peers = staged(sums.select("node", "peers"), "push-peers")
    given = seeds.where("weight > 0").groupBy("query_id", F.col("id").alias("node")).agg(F.sum("weight").alias("w"))
    given = staged(given.select("query_id", "node", (F.col("w") / F.sum("w").over(Window.partitionBy("query_id"))).alias("part")), "push-seeds")
    state = staged(given.select("query_id", "node", F.lit(0.0).alias("mass"), F.col("part").alias("residual")).join(peers, "node", "left"), "push-state")
    for _ in range(rounds):
        much = F.col("residual") > bound * F.coalesce("peers", F.lit(1))
        if state.where(much).isEmpty():
            break
        moving = state.where(much).select("query_id", "node", "peers", ((1 - restart) * F.col("residual")).alias("out"))
        handed = moving.where("peers is not null").join(steps, "node").select("query_id", F.col("peer").alias("node"), (F.col("out") * F.col("share")).alias("residual"))
        lost = moving.where("peers is null").groupBy("query_id").agg(F.sum("out").alias("out"))
        back = lost.join(given, "query_id").select("query_id", "node", (F.col("out") * F.col("part")).alias("residual"))
        kept = state.select("query_id", "node", (F.col("mass") + F.when(much, restart * F.col("residual")).otherwise(0.0)).alias("mass"), F.when(much, 0.0).otherwise(F.col("residual")).alias("residual"))
        moved = handed.union(back).select("query_id", "node", F.lit(0.0).alias("mass"), "residual")
        summed = kept.union(moved).groupBy("query_id", "node").agg(F.sum("mass").alias("mass"), F.sum("residual").alias("residual"))
        state = staged(summed.join(peers, "node", "left"), "push-state")
    return state.select("query_id", F.col("node").alias("id"), "mass", "residual")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label): all nodes take the most frequent label among their neighbours at once; ties go to the smallest label.

    Rounds are synchronous so that reruns agree, and end early when no label changes. A node's own label has no vote;
    isolated nodes keep theirs.
    """
    # numbers in the order of the ids: the smallest number is the smallest label
    ids = staged(nodes.select("id").distinct().orderBy("id").withColumn("n", F.monotonically_increasing_id()), "lpa-ids")
    links = blocks.numbered(ids, edges, F.lit(1.0))
    vote = _labels_by_rows if blocks.crowded(blocks.degrees(links), blocks.LINKS) else _labels_by_blocks
    won = ids.join(vote(links, rounds).hint("shuffle_hash"), "n", "left").select("id", F.coalesce("label", "n").alias("label"))  # isolated ones keep theirs
    return won.join(ids.toDF("name_of", "label").hint("shuffle_hash"), "label").select("id", F.col("name_of").alias("label"))


def _labels_by_blocks(links: DataFrame, rounds: int) -> DataFrame:
    """(n, label) of nodes with links."""
    return blocks.Blocks(links).run(lambda block: block[0], blocks.most_voted, lambda block, received, old: old, "int64", rounds, until_still=True).toDF("n", "label")


def _labels_by_rows(links: DataFrame, rounds: int) -> DataFrame:
    """The same where a node has more links than a block: its votes are summed before its labels meet, so a hub is no task of its own."""
    walk = staged(blocks.both_ways(links).groupBy("a", "b").agg(F.sum("w").alias("w")), "lpa-walk").repartition("b").persist(StorageLevel.MEMORY_AND_DISK)  # its lineage is a written table
    labels = staged(walk.select(F.col("a").alias("n")).distinct().withColumn("label", F.col("n")), "lpa-labels")
    for _ in range(rounds):
        votes = walk.join(labels, walk["b"] == labels["n"]).groupBy("a", "label").agg(F.sum("w").alias("votes"))
        won = votes.groupBy(F.col("a").alias("n")).agg(F.min(F.struct((-F.col("votes")).alias("v"), "label"))["label"].alias("won"))
        new = staged(labels.join(won, "n").select("n", F.col("won").alias("label"), (F.col("won") != F.col("label")).alias("moved")), "lpa-labels")
        labels = new.select("n", "label")
        if new.where("moved").isEmpty():
            break
    walk.unpersist()
    return labels


def communities(nodes: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """(label, size, title) of the groups with ``least`` nodes or more, titled by their first three names.

    The three names come out of a ranked window, so no group's names are gathered whole.
    """
    named = staged(nodes.select("id", "name").join(labels.hint("shuffle_hash"), "id"), "named")  # read twice
    rank = F.row_number().over(Window.partitionBy("label").orderBy("name", "id"))
    firsts = named.withColumn("rank", rank).where("rank <= 3").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("first"))
    sizes = named.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return sizes.join(firsts, "label").select("label", "size", F.array_join(F.transform("first", lambda x: x["name"]), ", ").alias("title"))


def community_rows(nodes: DataFrame, labels: DataFrame, propositions: DataFrame, least: int = 3, samples: int = 8, named: int = 12) -> DataFrame:
    """``communities`` with a summary of the first ``named`` names and up to ``samples`` pieces of evidence that name a member.

    Names and evidence are ranked and cut in windows, so no community is gathered whole; the members stay in ``labels``.
    ``propositions``: (id, text, node_ids).
    """
    big = communities(nodes, labels, least)
    kept = labels.join(big.select("label"), "label", "left_semi")
    order = F.row_number().over(Window.partitionBy("label").orderBy("name", "id"))
    firsts = nodes.select("id", "name").join(kept, "id").withColumn("rank", order).where(F.col("rank") <= named)
    firsts = firsts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("first"))
    summary = F.concat(F.lit("Cluster of: "), F.array_join(F.transform("first", lambda x: x["name"]), ", "))
    said = propositions.select(F.col("id").alias("pid"), "text", F.explode("node_ids").alias("id")).join(kept, "id").select("label", "pid", "text").distinct()
    said = said.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("pid"))).where(F.col("rank") <= samples)
    said = said.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("said"))
    rows = big.join(firsts, "label").join(said, "label", "left")
    return rows.select("label", "size", "title", summary.alias("summary"), F.coalesce(F.transform("said", lambda x: x["text"]), F.array().cast("array<string>")).alias("evidence"))


def neighbours(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """The edges of a node from its own view: (direction, role, type, peer_id, peer_name, peer_type)."""
    out = edges.where(F.col("source_id") == node).select(F.lit("out").alias("direction"), "type", F.col("target_id").alias("peer_id"))
    into = edges.where((F.col("target_id") == node) & (F.col("source_id") != node)).select(F.lit("in").alias("direction"), "type", F.col("source_id").alias("peer_id"))
    peers = nodes.select(F.col("id").alias("peer_id"), F.col("name").alias("peer_name"), F.col("type").alias("peer_type"))
    seen = out.unionByName(into).join(peers, "peer_id")
    return seen.withColumn("role", role(F.col("type"), F.col("direction") == "in"))


def lens(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """A node's edges counted by role, in the fixed order of roles."""
    order = F.array_position(F.array(*map(F.lit, ROLE_ORDER)), F.col("role"))
    return neighbours(nodes, edges, node).groupBy("role").agg(F.count("*").alias("n")).withColumn("place", order.cast("long"))


def compare(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(id, side) for the distinct targets of two nodes: shared, only_a or only_b."""
    seen = edges.where(F.col("source_id").isin(left, right)).groupBy(F.col("target_id").alias("id")).agg(
        F.bool_or(F.col("source_id") == left).alias("a"), F.bool_or(F.col("source_id") == right).alias("b")
    )
    return seen.select("id", F.when(F.col("a") & F.col("b"), "shared").when(F.col("a"), "only_a").otherwise("only_b").alias("side"))


def contradictions(edges: DataFrame, dates: DataFrame, hierarchical: tuple[str, ...] = ("extends", "improves", "cites"), mutual: tuple[str, ...] = ("extends", "improves")) -> DataFrame:
    """(id, reason): low confidence, a source older than what it builds on, or the same claim both ways. ``dates``: (id, date)."""
    low = edges.where("confidence <= 0.5").select("id", F.lit("low_confidence").alias("reason"))
    since, until = dates.toDF("source_id", "since"), dates.toDF("target_id", "until")
    older = edges.where(F.col("type").isin(*hierarchical)).join(since, "source_id").join(until, "target_id").where("since < until")
    back = edges.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"), "type")
    both = edges.where(F.col("type").isin(*mutual) & (F.col("source_id") != F.col("target_id"))).join(back, ["source_id", "target_id", "type"], "left_semi")
    return low.unionByName(older.select("id", F.lit("temporal").alias("reason"))).unionByName(both.select("id", F.lit("mutual").alias("reason")))


def contract(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge nodes: ``mapping`` has (loser, keeper). Edges move to the keeper; loops and repeated claims go, the least id stays."""
    kept = nodes.join(mapping.select(F.col("loser").alias("id")), "id", "left_anti")
    source = mapping.select(F.col("loser").alias("source_id"), F.col("keeper").alias("new_source"))
    target = mapping.select(F.col("loser").alias("target_id"), F.col("keeper").alias("new_target"))
    moved = edges.join(source, "source_id", "left").join(target, "target_id", "left")
    moved = moved.withColumn("source_id", F.coalesce("new_source", "source_id")).withColumn("target_id", F.coalesce("new_target", "target_id"))
    moved = moved.drop("new_source", "new_target").where("source_id <> target_id")
    claim = ["source_id", "target_id", "type"]
    rest = F.struct(*(F.col(c) for c in edges.columns if c not in claim))  # the claim itself is the key of its group
    best = moved.groupBy(*claim).agg(F.min_by(rest, "id").alias("row"))
    return kept, best.select(*claim, "row.*").select(*edges.columns)


def duplicates(nodes: DataFrame) -> DataFrame:
    """(loser, keeper) of nodes of one identity, domain and normalised name; the keeper has the smallest id."""
    identity = Window.partitionBy(F.coalesce("domain", F.lit("")), F.lower(F.trim("name")))
    return nodes.withColumn("keeper", F.min("id").over(identity)).where("id <> keeper").select(F.col("id").alias("loser"), "keeper")
