"""Answering many questions over a graph and its evidence at once: seeds, bounded expansion, walk, three signals, fusion, compression.

Every step is keyed by query_id and bounded for each question, so one plan answers a whole set of questions, and no step
reads a question's rows on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.domains import DEFAULT, domain_is
from loomfield.functions.vectors import cosine
from loomfield.operators import graph, retrieval
from loomfield.sources.tables import staged

#: Whole units that a walk's masses and an edge's weight are counted in; sums of them are exact in a double.
UNITS, WEIGHT_UNITS = 1e15, 1e9


@dataclass(frozen=True)
class Options:
    """Bounds of each step, and the weights of the three signals (0 turns one off)."""

    seeds: int = 8
    top_nodes: int = 25
    evidence: int = 10
    chars: float = 2000
    hops: int = 3
    nodes: int = 4000
    candidates: int = 400
    restart: float = 0.15
    rounds: int = 30
    balance: float = 0.7
    weights: dict = field(default_factory=lambda: {"graph": 2.0, "vector": 1.0, "lexical": 1.0})

    @property
    def depth(self) -> int:
        """Candidates of one signal."""
        return max(1, -(-self.candidates // 2))


@dataclass(frozen=True)
class Store:
    """nodes(id, name, type, domain), edges(id, source_id, target_id, type, confidence, domain), node_vectors(id, vector),
    propositions(id, text, node_ids, vector, domain); ids are strings."""

    nodes: DataFrame
    edges: DataFrame
    node_vectors: DataFrame
    propositions: DataFrame

    def scoped(self, domain: str = DEFAULT) -> Store:
        """What one domain owns: an edge needs the domain itself and at both ends."""
        own = domain_is(F.col("domain"), domain)
        nodes = self.nodes.where(own)
        vectors = self.node_vectors.where("vector is not null").join(nodes.select("id"), "id", "left_semi")
        edges = graph.within_domain(self.nodes, self.edges.where(own), own)
        return replace(self, nodes=nodes, edges=edges, node_vectors=vectors, propositions=self.propositions.where(own & F.col("vector").isNotNull()))


@dataclass(frozen=True)
class Answer:
    """seeds(query_id, id, name, score, rank), nodes(query_id, id, name, type, mass, rank), evidence(query_id, place, id, text,
    node_ids), stats(query_id, seeds, subgraph_nodes, subgraph_edges, candidates, truncated, chars)."""

    seeds: DataFrame
    nodes: DataFrame
    evidence: DataFrame
    stats: DataFrame


class Scanned:
    """One domain of a store as tables that are scanned for each set of questions; ``standing.Standing`` answers the same at rest."""

    def __init__(self, own: Store):
        weight = F.coalesce(F.col("confidence").cast("double"), F.lit(0.5))
        self.own, self.edges = own, own.edges.withColumn("w", F.when(weight == 0, 0.5).otherwise(weight))

    def near_nodes(self, asked: DataFrame, k: int) -> DataFrame:
        return retrieval.nearest(asked, self.own.node_vectors, k)

    def near_evidence(self, asked: DataFrame, k: int) -> DataFrame:
        return retrieval.nearest(asked, self.own.propositions.select("id", "vector"), k)

    def by_words(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score) of the ``k`` best by their words, ties by id."""
        found = retrieval.lexical(self.own.propositions, "id", "text", {r["query_id"]: r["text"] for r in asked.select("query_id", "text").toLocalIterator()})
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("score", F.round("score", 12)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def walk(self):
        """The edges at the nodes of a frontier, from either end: a function of (id)."""
        held = _walk(self.edges)
        return lambda frontier: held

    def named(self, ids: DataFrame) -> DataFrame:
        """(id, name, type) of at least these nodes."""
        return self.own.nodes.select("id", "name", "type")

    def naming(self, ids: DataFrame) -> DataFrame:
        """(node, id, node_ids): evidence that names at least these nodes, once for each of them."""
        return self.own.propositions.select("id", F.array_distinct("node_ids").alias("node_ids")).select(F.explode("node_ids").alias("node"), "id", "node_ids")

    def evidence(self, ids: DataFrame) -> DataFrame:
        """(id, text, node_ids, vector) of at least this evidence."""
        return self.own.propositions.select("id", "text", "node_ids", "vector")


def _walk(edges: DataFrame) -> DataFrame:
    return staged(graph.ends(edges, "id", "source_id", "target_id", "w").withColumnRenamed("id", "edge"), "field-walk")


def expand(seeds: DataFrame, edges, hops: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bounded neighbourhoods of (query_id, id): (query_id, id), (query_id, edge columns), (query_id) of those cut short.

    A hop takes up to 4 * ``most`` edges at the newest nodes, smallest ids first, and new nodes, smallest ids first, until
    there are ``most``; an edge stays also where its far node does not. Frontiers meet the edges as an equi join.
    ``edges``: a table, or a function that gives the rows (node, peer, edge, source_id, target_id, w) at the ids of a frontier.
    """
    held = None if callable(edges) else _walk(edges)
    near = edges if held is None else lambda frontier: held
    seen = staged(seeds.select("query_id", "id").distinct().withColumn("hop", F.lit(0)), "field-seen")
    taken, cut = [], []
    for hop in range(1, hops + 1):
        size = seen.groupBy("query_id").agg(F.count("*").alias("n"), F.max("hop").alias("last"))
        frontier = seen.join(size, "query_id").where((F.col("hop") == hop - 1) & (F.col("n") < most)).select("query_id", "id", "n")
        cut.append(size.where((F.col("n") >= most) & (F.col("last") == hop - 1)).select("query_id"))
        if held is None:
            frontier = staged(frontier, "field-frontier")
        walk = near(frontier.select("id"))
        met = frontier.join(walk, frontier["id"] == walk["node"]).groupBy("query_id", "n", "edge").agg(F.first(F.struct("source_id", "target_id", "w")).alias("e"))
        order = Window.partitionBy("query_id").orderBy("edge")
        met = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 4 * most)
        met = staged(met.select("query_id", "n", "edge", "e.*"), "field-edges")
        taken.append(met.select("query_id", "edge", "source_id", "target_id", "w"))
        new = met.select("query_id", "n", F.explode(F.array("source_id", "target_id")).alias("id")).distinct().join(seen, ["query_id", "id"], "left_anti")
        new = new.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
        cut.append(new.where(F.col("place") + F.col("n") > most).select("query_id"))
        seen = staged(seen.unionByName(new.where(F.col("place") + F.col("n") <= most).select("query_id", "id", F.lit(hop).alias("hop"))), "field-seen")
    edges = reduce(DataFrame.unionByName, taken).dropDuplicates(["query_id", "edge"])
    return seen.select("query_id", "id"), edges, reduce(DataFrame.unionByName, cut).distinct()


def whole(seeds: DataFrame, edges: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Neighbourhoods of (query_id, id) without a bound: (query_id, id) and (query_id, edge columns) of all that lies within ``hops``.

    What ``expand`` gives where nothing is cut. Nothing is put in order, so no task holds all rows of a question.
    """
    walk, key = _walk(edges), ["query_id", "id"]
    seen = staged(seeds.select(*key).distinct().withColumn("hop", F.lit(0)), "field-seen")
    taken = []
    for hop in range(1, hops + 1):
        frontier = seen.where(F.col("hop") == hop - 1).select(*key)
        met = frontier.join(walk, frontier["id"] == walk["node"]).select("query_id", "edge", "source_id", "target_id", "w")
        met = staged(met.dropDuplicates(["query_id", "edge"]), "field-edges")
        taken.append(met)
        new = met.select("query_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct().join(seen, key, "left_anti")
        seen = staged(seen.unionByName(new.select(*key, F.lit(hop).alias("hop"))), "field-seen")
    return seen.select(*key), reduce(DataFrame.unionByName, taken).dropDuplicates(["query_id", "edge"])


def walked(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, restart: float = 0.15, rounds: int = 30) -> DataFrame:
    """(query_id, id, mass) of a Personalized PageRank on each question's own bounded subgraph, one task for each.

    ``nodes``: (query_id, id); ``edges``: (query_id, source_id, target_id, w); ``seeds``: (query_id, id, score). Edges count both
    ways, parallel ones add up, loops and edges with an end outside drop out, weights of 0 or less count 0.01; scores of 0
    or less seed nothing, and without seeds every node is one; mass of nodes without edges returns to the seeds. Masses are
    whole numbers of 1 / UNITS after each round, so that their sums do not depend on an order.
    """
    usable = seeds.where("score > 0").select("query_id", "id", "score")
    rows = nodes.join(usable, ["query_id", "id"], "left").select("query_id", "id", F.lit(None).cast("string").alias("peer"), F.coalesce("score", F.lit(0.0)).alias("w"))
    rows = rows.unionByName(edges.select("query_id", F.col("source_id").alias("id"), F.col("target_id").alias("peer"), "w"))

    def walk(df: pd.DataFrame) -> pd.DataFrame:
        own = df["peer"].isna().to_numpy()
        ids = pd.Index(np.sort(df["id"].to_numpy()[own]))
        n, start = len(ids), np.zeros(len(ids))
        start[ids.get_indexer(df["id"][own])] = df["w"][own]
        start = start / start.sum() if start.sum() > 0 else np.full(n, 1 / max(n, 1))
        links = df[~own]
        a, b = ids.get_indexer(links["id"]), ids.get_indexer(links["peer"])
        fit = (a >= 0) & (b >= 0) & (a != b)
        w = links["w"].to_numpy(float)[fit]
        w = np.floor(np.where(w > 0, w, 0.01) * WEIGHT_UNITS + 0.5)
        source, target = np.concatenate([a[fit], b[fit]]), np.concatenate([b[fit], a[fit]])
        w = np.concatenate([w, w])
        total = np.bincount(source, w, n)
        share = w / total[source] if len(w) else w
        idle, mass = total == 0, np.floor(start * UNITS + 0.5)
        for _ in range(rounds):
            moved = np.bincount(target, np.floor(mass[source] * share + 0.5), n) if len(w) else np.zeros(n)
            mass = np.floor((1 - restart) * (moved + mass[idle].sum() * start) + restart * UNITS * start + 0.5)
        return pd.DataFrame({"query_id": df["query_id"].iloc[0], "id": ids, "mass": mass / UNITS})

    return rows.groupBy("query_id").applyInPandas(walk, "query_id string, id string, mass double")


def walked_by_rounds(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, restart: float = 0.15, rounds: int = 30) -> DataFrame:
    """``walked`` for neighbourhoods of any size: each round is a join and an aggregation over all questions, and no task holds a question.

    The same masses in the same units; weights and what idle nodes hold are whole numbers, whose sums do not depend on an order.
    """
    key = ["query_id", "id"]
    given = nodes.join(seeds.where("score > 0").groupBy(*key).agg(F.max("score").alias("score")), key, "left").fillna(0.0, ["score"])
    sums = given.groupBy("query_id").agg(F.sum("score").alias("all"), F.count(F.lit(1)).alias("n"))
    start = given.join(sums, "query_id").select(*key, F.when(F.col("all") > 0, F.col("score") / F.col("all")).otherwise(1 / F.col("n")).alias("start"))
    inside = lambda end: nodes.select("query_id", F.col("id").alias(end))
    weight = F.floor(F.when(F.col("w") > 0, F.col("w")).otherwise(0.01) * WEIGHT_UNITS + 0.5).cast("double")
    links = edges.where("source_id <> target_id").select("query_id", "source_id", "target_id", weight.alias("w"))
    links = links.join(inside("source_id"), ["query_id", "source_id"], "left_semi").join(inside("target_id"), ["query_id", "target_id"], "left_semi")
    way = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("peer"))
    links = staged(links.select("query_id", "w", F.explode(F.array(way("source_id", "target_id"), way("target_id", "source_id"))).alias("x")).select("query_id", "x.*", "w"), "walk-links")
    totals = links.groupBy(*key).agg(F.sum("w").alias("total"))
    steps = staged(links.join(totals, key).select(*key, "peer", (F.col("w") / F.col("total")).alias("share")), "walk-steps")
    state = start.join(totals, key, "left").select(*key, "start", F.col("total").isNull().alias("idle"))
    state = staged(state.withColumn("mass", F.floor(F.col("start") * UNITS + 0.5).cast("double")), "walk-mass")
    for _ in range(rounds):
        moved = state.select(*key, "mass").where("mass <> 0").join(steps, key).groupBy("query_id", F.col("peer").alias("id")).agg(F.sum(F.floor(F.col("mass") * F.col("share") + 0.5).cast("double")).alias("moved"))
        idle = state.groupBy("query_id").agg(F.sum(F.when(F.col("idle"), F.col("mass")).otherwise(0.0)).alias("back"))
        new = state.drop("mass").join(moved, key, "left").join(idle, "query_id")
        mass = F.floor((1 - restart) * (F.coalesce("moved", F.lit(0.0)) + F.col("back") * F.col("start")) + restart * UNITS * F.col("start") + 0.5).cast("double")
        state = staged(new.select(*key, "start", "idle", mass.alias("mass")), "walk-mass")
    return state.select(*key, (F.col("mass") / UNITS).alias("mass"))


def graph_signal(naming: DataFrame, mass: DataFrame, top: DataFrame, depth: int) -> DataFrame:
    """(query_id, id, score): evidence that names one of the ``top`` nodes, by the mass of all nodes it names.

    ``naming``: (node, id, node_ids) of the evidence that names them.
    """
    hit = naming.join(top.select("query_id", F.col("id").alias("node")), "node").groupBy("query_id", "id").agg(F.first("node_ids").alias("node_ids"))
    scored = hit.select("query_id", "id", F.explode("node_ids").alias("node")).join(mass.select("query_id", F.col("id").alias("node"), "mass"), ["query_id", "node"], "left")
    scored = scored.groupBy("query_id", "id").agg(F.round(F.sum(F.coalesce("mass", F.lit(0.0))), 12).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth).drop("rank")


def retrieve(store, questions: DataFrame, domain: str = DEFAULT, options: Options = Options()) -> Answer:
    """Evidence for every question of (query_id, text, vector), a stated set, out of one domain.

    The nearest nodes seed a bounded expansion and a walk; evidence is ranked by the mass of the nodes it names, by its own
    vector and by its words; reciprocal ranks fuse the lists, and maximal marginal relevance picks what fits the budget.

    Defined results: a question of a domain without node vectors has no seeds, no evidence and zeros in its stats; a blank
    text has no lexical list; ties go to the smaller id; questions that repeat an id are one question.

    ``store``: a Store, whose tables are scanned for the set of questions, or one domain of it at rest (``standing.Standing``),
    of which only what the questions touch is read.
    """
    own = Scanned(store.scoped(domain)) if isinstance(store, Store) else store
    asked = staged(questions.select(F.col("query_id").cast("string").alias("query_id"), "text", "vector").dropDuplicates(["query_id"]), "field-questions")
    seeds = staged(own.near_nodes(asked, options.seeds), "field-seeds")
    answered = staged(asked.join(seeds.select("query_id").distinct(), "query_id", "left_semi"), "field-answered")
    nodes, edges, cut = expand(seeds, own.walk(), options.hops, options.nodes)
    nodes, edges = staged(nodes, "field-nodes"), staged(edges, "field-subgraph")
    mass = staged(walked(nodes, edges, seeds, options.restart, options.rounds).withColumn("mass", F.round("mass", 12)), "field-mass")
    order = Window.partitionBy("query_id").orderBy(F.desc("mass"), "id")
    top = mass.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.top_nodes)
    top = staged(top, "field-top")
    top = staged(top.join(own.named(top.select("id")), "id", "left"), "field-top")

    weights, lists = options.weights, []
    if weights.get("graph", 0) > 0:
        naming = own.naming(top.select("id"))
        lists.append(retrieval.ranked(graph_signal(naming, mass, top, options.depth), "graph", float(weights["graph"])))
    if weights.get("vector", 0) > 0:
        lists.append(retrieval.ranked(own.near_evidence(answered, options.depth), "vector", float(weights["vector"])))
    if weights.get("lexical", 0) > 0:
        lists.append(retrieval.ranked(own.by_words(answered, options.depth), "lexical", float(weights["lexical"])))
    fused = staged(retrieval.fuse(reduce(DataFrame.unionByName, lists), options.candidates), "field-fused")
    chosen = fused.join(own.evidence(fused.select("id")), "id").withColumn("cost", F.length("text").cast("double"))
    picked = retrieval.compress(chosen, options.evidence, options.chars, options.balance)
    evidence = staged(picked.join(chosen.select("query_id", "id", "text", "node_ids"), ["query_id", "id"]), "field-evidence")

    named = seeds.join(own.named(seeds.select("id")).select("id", "name"), "id", "left")
    counts = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    stats = asked.select("query_id")
    for df, name in ((seeds, "seeds"), (nodes, "subgraph_nodes"), (edges, "subgraph_edges"), (fused, "candidates")):
        stats = stats.join(counts(df, name), "query_id", "left")
    stats = stats.join(cut.withColumn("truncated", F.lit(True)), "query_id", "left")
    stats = stats.join(evidence.groupBy("query_id").agg(F.sum(F.length("text")).alias("chars")), "query_id", "left")
    return Answer(named, top, evidence, stats.fillna(0).fillna({"truncated": False}))


def context(evidence: DataFrame) -> DataFrame:
    """(query_id, context): the evidence of each question, numbered, a line each; bounded by the evidence's own budget."""
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("text"))
    return evidence.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def naive_baseline(store: Store, questions: DataFrame, domain: str = DEFAULT, k: int = 10) -> DataFrame:
    """(query_id, chars): characters of the ``k`` nearest pieces of evidence, what plain vector search would read."""
    props = store.scoped(domain).propositions
    near = retrieval.nearest(questions, props.select("id", "vector"), k)
    return near.join(props.select("id", "text"), "id").groupBy("query_id").agg(F.sum(F.length("text")).alias("chars"))


def retrieve_whole(store: Store, questions: DataFrame, domain: str = DEFAULT, options: Options = Options()) -> DataFrame:
    """(query_id, place, id) by the earlier algorithm, which walks the whole domain for every question: the benchmark's other arm.

    Evidence counts if it names a top node or any node with mass; its relevance is its cosine, weighted by one and fifty
    times the mass it names. Each question's walk is a walk over all nodes, so this grows with the corpus where
    ``retrieve`` does not; questions go one after the other.
    """
    own = store.scoped(domain)
    asked = staged(questions.select(F.col("query_id").cast("string").alias("query_id"), "text", "vector").dropDuplicates(["query_id"]), "field-questions")
    seeds = staged(retrieval.nearest(asked, own.node_vectors, options.seeds).where("score > 0"), "field-seeds")
    props = staged(own.propositions.select("id", F.array_distinct("node_ids").alias("node_ids"), "text", "vector"), "field-propositions")
    weight = F.coalesce(F.col("confidence").cast("double"), F.lit(0.5))
    edges = staged(own.edges.withColumn("confidence", F.when(weight == 0, 0.5).otherwise(weight)), "field-edges")
    out = None
    for row in asked.select("query_id").orderBy("query_id").toLocalIterator():
        q = row["query_id"]
        mass = graph.personalized_pagerank(own.nodes, edges, seeds.where(F.col("query_id") == q).select("id", F.col("score").alias("weight")), options.restart, options.rounds)
        named = props.select("id", F.explode("node_ids").alias("node")).join(mass.select(F.col("id").alias("node"), "mass"), "node").groupBy("id").agg(F.sum("mass").alias("mass")).where("mass > 0")
        # no more candidates can be chosen than fused candidates could: the best by weighted cosine
        near = named.join(props, "id").join(F.broadcast(asked.where(F.col("query_id") == q).select("query_id", F.col("vector").alias("asked"))))
        scored = near.withColumn("relevance", cosine(F.col("vector"), F.col("asked")) * (1 + 50 * F.col("mass"))).orderBy(F.desc("relevance"), "id").limit(options.candidates)
        picked = retrieval.compress(scored.withColumn("cost", F.length("text").cast("double")), options.evidence, options.chars, options.balance)
        picked = staged(picked, "field-whole")
        out = picked if out is None else out.unionByName(picked)
    return out.select("query_id", "place", "id")
