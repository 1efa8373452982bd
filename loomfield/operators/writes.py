"""What an extraction writes: mentions, twins, canonical relationships, nodes, edges, provenance and evidence.

Rows are keyed by ``chunk`` (any type), a piece of one paper; ids of new rows are hashes of their identity, so a repeated
write gives the same rows.
"""

from __future__ import annotations

from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.names import may_merge
from loomfield.functions.text import edge_type, entity_type, normalise_name
from loomfield.operators.resolution import SIMILAR

# How much of an evidence text provenance and propositions keep.
EVIDENCE, PROPOSITION = 1000, 500
# End of fixed values.


class Merging(Enum):
    """What may make two names one node: equality, or similarity that the guard allows (``VECTOR`` is guarded too)."""

    EXACT = "exact"
    GUARDED = "guarded"
    VECTOR = "vector"


def gather_mentions(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(chunk, place, key, mention, type): what a chunk names, each name once, the first naming wins.

    ``entities``: (chunk, place, mention, type); ``relations``: (chunk, place, subject, object). Entities come first, then
    the ends of relationships, which are concepts; ``place`` counts a chunk's mentions from 1.
    """
    rows = entities.select("chunk", F.struct(F.lit(0).alias("k"), F.col("place").cast("long").alias("place"), F.lit(0).alias("end")).alias("at"), "mention", entity_type(F.col("type")).alias("type"))
    for i, end in enumerate(("subject", "object")):
        rows = rows.unionByName(relations.select("chunk", F.struct(F.lit(1).alias("k"), F.col("place").cast("long").alias("place"), F.lit(i).alias("end")).alias("at"), F.col(end).alias("mention"), F.lit("concept").alias("type")))
    rows = rows.withColumn("key", normalise_name(F.coalesce("mention", F.lit("")))).where("key <> ''")
    first = rows.groupBy("chunk", "key").agg(F.min_by(F.struct("at", F.trim("mention").alias("mention"), "type"), "at").alias("r")).select("chunk", "key", "r.*")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("chunk").orderBy("at"))).drop("at")


def twins(fresh: DataFrame, mode: Merging = Merging.GUARDED) -> DataFrame:
    """(chunk, key, canonical): for mentions new to the graph, the earlier mention of their chunk that each one repeats.

    ``fresh``: (chunk, place, key, mention, type, vector). In order, a mention joins the most similar earlier one that is
    itself canonical, above the threshold, of a type that fits and allowed by the guard; else it is canonical. Similar
    pairs are found by matrices within a chunk, the guard runs over those few in Catalyst.
    """
    alone = fresh.select("chunk", "key", F.col("mention").alias("canonical"))
    if mode is Merging.EXACT:
        return alone
    kind = fresh.schema["chunk"].dataType.simpleString()

    def similar(df: pd.DataFrame) -> pd.DataFrame:
        df = df[df["vector"].notna()].sort_values("place")
        if len(df) < 2:
            return pd.DataFrame({"chunk": [], "late": [], "early": [], "score": []})
        m = np.stack([np.asarray(v, float) for v in df["vector"]])
        size = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
        late, early, score, place = [], [], [], df["place"].to_numpy()
        for lo in range(0, len(m), 512):
            near = m[lo : lo + 512] @ m.T
            a, b = np.nonzero(near > SIMILAR)
            ok = b < a + lo
            late.append(place[a[ok] + lo]), early.append(place[b[ok]]), score.append(near[a[ok], b[ok]])
        return pd.DataFrame({"chunk": df["chunk"].iloc[0], "late": np.concatenate(late), "early": np.concatenate(early), "score": np.concatenate(score)})

    pairs = fresh.select("chunk", F.col("place").cast("long").alias("place"), "vector").groupBy("chunk").applyInPandas(similar, f"chunk {kind}, late bigint, early bigint, score double")
    named = lambda p: fresh.select("chunk", F.col("place").cast("long").alias(p), F.col("mention").alias(f"{p}_name"), F.col("type").alias(f"{p}_type"))
    pairs = pairs.join(named("late"), ["chunk", "late"]).join(named("early"), ["chunk", "early"])
    fit = (F.col("late_type") == F.col("early_type")) | (F.col("late_type") == "paper") | (F.col("early_type") == "paper")
    pairs = pairs.where(fit & may_merge(F.col("late_name"), F.col("early_name"), F.col("late_type"), F.col("early_type")))

    def pick(df: pd.DataFrame) -> pd.DataFrame:
        joined: dict[int, int] = {}
        for late, rows in df.sort_values(["late", "early"]).groupby("late", sort=True):
            rows = rows[~rows["early"].isin(joined.keys())]
            if len(rows):
                joined[late] = int(rows["early"].iloc[int(rows["score"].to_numpy().argmax())])
        return pd.DataFrame({"chunk": df["chunk"].iloc[0], "late": list(joined), "early": list(joined.values())})

    chosen = pairs.select("chunk", "late", "early", "score").groupBy("chunk").applyInPandas(pick, f"chunk {kind}, late bigint, early bigint")
    chosen = chosen.join(named("early").select("chunk", "early", "early_name"), ["chunk", "early"]).select("chunk", F.col("late").alias("place"), "early_name")
    placed = fresh.select("chunk", F.col("place").cast("long").alias("place"), "key", "mention").join(chosen, ["chunk", "place"], "left")
    return placed.select("chunk", "key", F.coalesce("early_name", "mention").alias("canonical"))


def canonical_relations(relations: DataFrame, names: DataFrame) -> DataFrame:
    """``relations`` with ``source`` and ``target`` by the canonical ``names`` (chunk, key, canonical) and ``type`` of the predicate; those
    with an unresolved end or both ends in one name go."""
    end = lambda c, to: names.select("chunk", F.col("key").alias(f"{c}_key"), F.col("canonical").alias(to))
    keyed = relations.withColumn("subject_key", normalise_name(F.col("subject"))).withColumn("object_key", normalise_name(F.col("object")))
    both = keyed.join(end("subject", "source"), ["chunk", "subject_key"]).join(end("object", "target"), ["chunk", "object_key"]).where("source <> target")
    both = both.withColumn("type", edge_type(F.col("predicate"))).withColumn("confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(0.5)))
    return both.drop("subject_key", "object_key", "predicate")


def _hash(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def create_or_get(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``nodes`` (id, type, domain, name, paper_id) and the identities of ``wanted`` (type, domain, name, paper_id) that it lacks.

    An identity is a domain and a name in lower case; of several wanted rows of one, the smallest paper and name give it,
    whatever the order of writes; papers belong to no paper.
    """
    identity = lambda df: df.withColumn("__d", F.coalesce("domain", F.lit(""))).withColumn("__n", normalise_name(F.col("name")))
    new = identity(wanted).where("__n <> ''").join(identity(nodes).select("__d", "__n"), ["__d", "__n"], "left_anti")
    new = new.groupBy("__d", "__n").agg(F.min(F.struct("paper_id", "name", "type", "domain")).alias("r"))
    kept = F.when(F.col("r.type") == "paper", F.lit(None).cast("string")).otherwise(F.col("r.paper_id").cast("string"))
    return nodes.select("id", "type", "domain", "name", "paper_id").unionByName(new.select(_hash(F.col("__d"), F.col("__n")).alias("id"), "r.type", "r.domain", "r.name", kept.alias("paper_id")))


def mention_edges(edges: DataFrame, sources: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` and ``sources`` with a mention edge for each pair of ``named`` (paper_node, target_id, domain, paper_id, section,
    chunk_index), once for a pair, and a source for each place; a paper does not mention itself. Repeats change nothing."""
    pairs = named.where("paper_node <> target_id")
    held = edges.where("type = 'mentions'").select(F.col("source_id").alias("paper_node"), "target_id", F.col("id").alias("held"))
    new = pairs.groupBy("paper_node", "target_id").agg(F.min("domain").alias("domain")).join(held, ["paper_node", "target_id"], "left_anti")
    own = _hash(F.col("paper_node"), F.lit("mentions"), F.col("target_id"))
    written = new.select(own.alias("id"), F.col("paper_node").alias("source_id"), "target_id", F.lit("mentions").alias("type"), "domain", F.lit(1.0).alias("confidence"))
    least = held.groupBy("paper_node", "target_id").agg(F.min("held").alias("held"))
    at = pairs.join(least, ["paper_node", "target_id"], "left").select(F.coalesce("held", own).alias("edge_id"), "paper_id", "section", "chunk_index", F.lit(None).cast("string").alias("text")).dropDuplicates(["edge_id", "paper_id", "chunk_index"])
    at = at.join(sources.select("edge_id", "paper_id", "chunk_index"), ["edge_id", "paper_id", "chunk_index"], "left_anti")
    return edges.select(*written.columns).unionByName(written), sources.select("edge_id", "paper_id", "section", "chunk_index", "text").unionByName(at.select("edge_id", "paper_id", "section", "chunk_index", "text"))


def fuzzy_ends(names: DataFrame, known: DataFrame) -> DataFrame:
    """(chunk, name, id) of names by the entities of their chunk: equal in lower case, else the first in order that contains
    the name or lies in it. ``names``: (chunk, name); ``known``: (chunk, place, name, id), the few entities of one chunk."""
    asked = names.where("name is not null and name <> ''").distinct().withColumn("low", F.lower("name"))
    held = known.select("chunk", "place", F.lower("name").alias("own"), "id").where("own <> ''")
    near = asked.join(held, "chunk").where((F.col("low") == F.col("own")) | F.contains("own", "low") | F.contains("low", "own"))
    return near.groupBy("chunk", "name").agg(F.min_by("id", F.struct((F.col("low") != F.col("own")).alias("unlike"), "place")).alias("id"))


def relation_rows(accepted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, sources and propositions of accepted relationships (id, source_id, target_id, type, domain, confidence, paper_id,
    section, chunk_index, evidence): one edge each, its evidence cut to EVIDENCE as provenance and to PROPOSITION as evidence."""
    kind = F.when(F.trim(F.coalesce("type", F.lit(""))) == "", "uses").otherwise(F.col("type"))
    score = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.5).otherwise(F.col("confidence"))
    edges = accepted.select("id", "source_id", "target_id", kind.alias("type"), "domain", score.alias("confidence"))
    sources = accepted.select(F.col("id").alias("edge_id"), "paper_id", "section", "chunk_index", F.left("evidence", F.lit(EVIDENCE)).alias("text"))
    said = accepted.where("evidence is not null and evidence <> ''")
    return edges, sources, said.select(F.concat(F.lit("p-"), "id").alias("id"), "paper_id", F.left("evidence", F.lit(PROPOSITION)).alias("text"), F.array("source_id", "target_id").alias("node_ids"), "section", "domain")
