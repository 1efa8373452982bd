"""Hierarchy in the Poincaré ball: training by Riemannian steps, and a node's broader and narrower neighbours."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.functions.vectors import poincare_distance

# The published training parameters.
DIMENSIONS, EPOCHS, RATE, NEGATIVES, WARM, START = 10, 100, 0.3, 5, 10, 1e-3
EDGE = 1e-5
NEIGHBOURS = 8
# End of fixed values.


def _inside(points: np.ndarray) -> np.ndarray:
    """Points pulled back strictly inside the ball."""
    length = np.linalg.norm(points, axis=-1, keepdims=True)
    return np.where(length >= 1 - EDGE, points * (1 - EDGE) / np.maximum(length, EDGE), points)


def _slope(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Gradient of the distance between rows of ``at`` and ``to`` by the rows of ``at``."""
    a, b = 1 - (at * at).sum(-1, keepdims=True), 1 - (to * to).sum(-1, keepdims=True)
    gamma = 1 + 2 * ((at - to) ** 2).sum(-1, keepdims=True) / (a * b + EDGE)
    scale = 4 / (b * np.sqrt(np.maximum(gamma * gamma - 1, EDGE)) + EDGE)
    inner = ((to * to).sum(-1, keepdims=True) - 2 * (at * to).sum(-1, keepdims=True) + 1) / (a * a + EDGE)
    return scale * (inner * at - to / a)


def distances(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    room = (1 - (u * u).sum(-1)) * (1 - (v * v).sum(-1)) + EDGE
    return np.arccosh(np.maximum(1, 1 + 2 * ((u - v) ** 2).sum(-1) / room))


def fit(n: int, pairs: np.ndarray, seed: int, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, negatives: int = NEGATIVES) -> np.ndarray:
    """Points of ``n`` nodes after stepping through ``pairs`` (u, v) in order, each against random negatives.

    Randomness comes from ``seed``, so reruns agree. Negatives that are an end of the pair are left out.
    """
    rng = np.random.default_rng(seed)
    points = (rng.random((n, dimensions)) - 0.5) * START
    for epoch in range(epochs if len(pairs) else 0):
        step = rate / 10 if epoch < WARM else rate
        drawn = rng.integers(0, n, (len(pairs), negatives))
        for (u, v), others in zip(pairs, drawn):
            ends = np.concatenate([[v], others[(others != u) & (others != v)]])
            near = np.exp(-distances(points[u], points[ends]))
            pull = -near / (near.sum() + EDGE)
            pull[0] += 1
            mine = (pull[:, None] * _slope(np.broadcast_to(points[u], (len(ends), dimensions)), points[ends])).sum(0)
            theirs = pull[:, None] * _slope(points[ends], np.broadcast_to(points[u], (len(ends), dimensions)))
            room = ((1 - (points[ends] ** 2).sum(-1, keepdims=True)) ** 2) / 4
            np.subtract.at(points, ends, step * room * theirs)
            points[ends] = _inside(points[ends])
            points[u] -= step * (1 - (points[u] ** 2).sum()) ** 2 / 4 * mine
            points[u] = _inside(points[u])
    return points


def train(nodes: DataFrame, edges: DataFrame, hierarchical: tuple[str, ...], **parameters) -> DataFrame:
    """(domain, id, point): points of every domain's nodes, trained on its edges of ``hierarchical`` types.

    Training goes pair by pair over all points of a domain, so a domain is one task: it must fit one worker (some 10^6
    nodes). ``nodes``: (id, domain), ``edges``: (source_id, target_id, type, domain); rows go in order of ids, and the seed comes from
    the domain's name.
    """
    own = F.coalesce("domain", F.lit("default"))
    rows = nodes.select(own.alias("domain"), "id", F.lit(None).cast("string").alias("peer"))
    links = edges.where(F.col("type").isin(*hierarchical)).select(own.alias("domain"), F.col("source_id").alias("id"), F.col("target_id").alias("peer"))

    def learn(df: pd.DataFrame) -> pd.DataFrame:
        ids = pd.Index(sorted(df.loc[df["peer"].isna(), "id"].unique()))
        links = df[df["peer"].notna()].sort_values(["id", "peer"])
        u, v = ids.get_indexer(links["id"]), ids.get_indexer(links["peer"])
        fitting = (u >= 0) & (v >= 0) & (u != v)
        domain = df["domain"].iloc[0]
        seed = int.from_bytes(hashlib.sha256(domain.encode()).digest()[:8], "little")
        points = fit(len(ids), np.stack([u[fitting], v[fitting]], axis=1), seed, **parameters)
        return pd.DataFrame({"domain": domain, "id": ids, "point": list(points)})

    return rows.unionByName(links).groupBy("domain").applyInPandas(learn, "domain string, id string, point array<double>")


def hierarchy(points: DataFrame, node: str, k: int = NEIGHBOURS) -> DataFrame:
    """(id, distance, norm, side, rank): of the 3k nearest points, up to ``k`` nearer the centre than the node (general) and up to
    ``k`` others (specific). ``points``: (id, point); an unknown node has no neighbours."""
    size = lambda p: F.sqrt(F.aggregate(p, F.lit(0.0), lambda s, x: s + x * x))
    own = points.where(F.col("id") == node).select(F.col("point").alias("own")).limit(1)
    far = points.where(F.col("id") != node).join(F.broadcast(own))  # one row
    near = far.select("id", poincare_distance(F.col("own"), F.col("point")).alias("distance"), size(F.col("point")).alias("norm"), size(F.col("own")).alias("limit")).orderBy("distance", "id").limit(3 * k)
    side = F.when(F.col("norm") < F.col("limit"), "general").otherwise("specific")
    ranked = near.withColumn("side", side).groupBy("side").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id", "norm"))), 1, k).alias("near"))  # 3k rows at most
    return ranked.select("side", F.posexplode("near").alias("at", "n")).select("n.id", "n.distance", "n.norm", "side", (F.col("at") + 1).alias("rank"))
