"""Resolving mentions to nodes, and validating relationships by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.names import BY_NAME_ONLY, may_merge, merge_keys
from loomfield.functions.text import normalise_name

# Thresholds and the kinds of ends that relationship types allow.
SIMILAR, FLOOR, SOFT = 0.82, 0.4, 0.2
KNOWN = ["paper", "method", "concept", "dataset", "metric"]
MEASURES = ["dataset", "metric"]
BETWEEN_WORKS = ["extends", "improves", "compares_to"]
# End of fixed values.


def _mergeable(pairs: DataFrame) -> DataFrame:
    """The rows of (name, type, node_name, node_type, ...) that the guard lets be one; it judges equal pairs once."""
    kinds = ["name", "node_name", "type", "node_type"]
    judged = pairs.select(*kinds).distinct().where(may_merge(*[F.col(c) for c in kinds]))
    return pairs.join(judged, kinds, "left_semi")


def resolve(mentions: DataFrame, nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(mention_id, node_id, how): by exact name first, else the most similar candidate above SIMILAR that may be merged.

    ``mentions``: (mention_id, name, type); ``nodes``: (id, name, type); ``near``: (mention_id, id, score) candidates.
    Candidates are of the mention's type unless either side is a paper; the guard then refuses papers. Mentions without a
    match have a null node.
    """
    keyed = mentions.withColumn("key", normalise_name(F.col("name")))
    exact = nodes.groupBy(normalise_name(F.col("name")).alias("key")).agg(F.min("id").alias("exact_id"))
    named = nodes.select("id", F.col("name").alias("node_name"), F.col("type").alias("node_type"))
    pairs = near.where(F.col("score") > SIMILAR).join(named, "id").join(mentions, "mention_id")
    alike = (F.col("type") == F.col("node_type")) | (F.col("type") == "paper") | (F.col("node_type") == "paper")
    fit = _mergeable(pairs.where(alike))
    best = fit.groupBy("mention_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id"))["id"].alias("near_id"))
    found = keyed.join(exact, "key", "left").join(best, "mention_id", "left")
    how = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("near_id").isNotNull(), "similar").otherwise("new")
    return found.select("mention_id", F.coalesce("exact_id", "near_id").alias("node_id"), how.alias("how"))


def nearest_of_block(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(mention_id, id, score): the one candidate of a mention's block that ``resolve`` would choose, where there is one.

    ``mentions``: (mention_id, name, type, block); ``nodes``: (id, name, type, block, score), the score the same for every mention of
    the block. Whether two may be merged depends on names and types alone, so the best node stands for those of its block, name and
    type, mentions meet it as classes of the same three, and only by keys that names share which may be merged: no block is paired with
    itself, however many copies it holds.
    """
    papers = F.lower(F.coalesce("type", F.lit(""))).isin(*BY_NAME_ONLY)  # the guard refuses them on either side
    asked = mentions.where(~papers).groupBy("block", "type", "name").agg(F.lit(1).alias("one"))
    asked = asked.select("block", "type", "name", F.explode(merge_keys(F.col("name"))).alias("key"))
    best = F.min(F.struct((-F.col("score")).alias("s"), "id"))
    held = nodes.where((F.col("score") > SIMILAR) & ~papers).groupBy("block", "type", F.col("name").alias("node_name")).agg(best.alias("best"))
    held = held.select("block", "type", "node_name", "best", F.explode(merge_keys(F.col("node_name"), other_side=True)).alias("key"))
    fit = _mergeable(asked.join(held, ["block", "type", "key"]).withColumn("node_type", F.col("type")))
    chosen = fit.groupBy("block", "type", "name").agg(F.min("best").alias("best"))
    return mentions.join(chosen, ["block", "type", "name"]).select("mention_id", "best.id", (-F.col("best.s")).alias("score"))


def validate(relations: DataFrame) -> DataFrame:
    """Relationships with ``verdict`` and ``reason``: degenerate, duplicate, type_mismatch or low_confidence.

    ``relations``: (id, source, source_type, target, target_type, type, confidence). Types outside KNOWN never reject.
    The first acceptable claim by id is accepted; only those after it are duplicates.
    """
    kind_of = {e: F.when(F.col(f"{e}_type") == "paper_reference", "paper").otherwise(F.col(f"{e}_type")) for e in ("source", "target")}
    source, target = kind_of["source"], kind_of["target"]
    measured = source.isin(*MEASURES) | target.isin(*MEASURES)
    wrong = F.when(F.col("type") == "evaluates_on", target.isin(*KNOWN) & ~target.isin(*MEASURES)).when(F.col("type").isin(*BETWEEN_WORKS), measured)
    no_paper = source.isin(*KNOWN) & target.isin(*KNOWN) & (source != "paper") & (target != "paper")
    given = F.coalesce(F.col("confidence"), F.lit(0.5))
    soft = F.coalesce((F.col("type") == "authored_by") & no_paper, F.lit(False))
    score = F.when(soft, F.greatest(F.lit(0.0), given - SOFT)).otherwise(given)
    a, b = normalise_name(F.coalesce("source", F.lit(""))), normalise_name(F.coalesce("target", F.lit("")))
    judged = relations.withColumn("score", score).withColumn("__a", a).withColumn("__b", b)
    empty = (F.col("__a") == "") | (F.col("__b") == "") | (F.col("__a") == F.col("__b"))
    other = F.when(F.coalesce(wrong, F.lit(False)), "type_mismatch").when(F.col("score") < FLOOR, "low_confidence")
    judged = judged.withColumn("__bad", F.when(empty, "degenerate").otherwise(other))
    accepted = F.min(F.when(F.col("__bad").isNull(), F.col("id"))).over(Window.partitionBy("__a", "type", "__b"))
    reason = F.when(empty, "degenerate").when(F.col("id") > accepted, "duplicate").otherwise(F.col("__bad"))
    judged = judged.withColumn("reason", reason).withColumn("verdict", F.when(F.col("reason").isNull(), "accept").otherwise("reject"))
    return judged.drop("__a", "__b", "__bad")
