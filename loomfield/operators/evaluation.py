"""Judging rankings: recall, precision, reciprocal rank, nDCG, and nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(retrieved: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """One row per question of ``gold`` or ``retrieved``: (query_id, recall, precision, reciprocal_rank, ndcg).

    ``retrieved``: (query_id, id, rank); ``gold``: (query_id, id). With nothing to find, recall and nDCG are 1;
    with nothing retrieved, precision is 0.
    """
    want = gold.select("query_id", "id").distinct().withColumn("good", F.lit(True))
    judged = retrieved.where(F.col("rank") <= k).join(want, ["query_id", "id"], "left").select("query_id", "rank", F.coalesce("good", F.lit(False)).alias("good"))
    return judged_metrics(judged, want.groupBy("query_id").agg(F.count("*").alias("wanted")), k)


def judged_metrics(judged: DataFrame, sizes: DataFrame, k: int = 10) -> DataFrame:
    """``ranking_metrics`` of judged lists (query_id, rank, good), given how many good ones there are (query_id, wanted)."""
    hit = judged.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if("good").alias("hits"), F.min(F.when(F.col("good"), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("good"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"),
    )
    rows = sizes.join(hit, "query_id", "full").fillna(0, ["wanted", "n", "hits"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("wanted", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return rows.select(
        "query_id",
        F.when(F.col("wanted") == 0, 1.0).otherwise(F.try_divide("hits", "wanted")).alias("recall"),
        F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.col("wanted") == 0, 1.0).otherwise(F.coalesce("gain", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def latency(scores: DataFrame, *by: str, column: str = "latency_ms") -> DataFrame:
    """Nearest-rank p50 and p95 for each group."""
    return scores.groupBy(*by).agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95))))


def scorecard(scores: DataFrame, *by: str) -> DataFrame:
    """Means over the questions of each group: recall, ndcg, mrr, found (share with any gold), chars of context."""
    mean = {"recall": "recall", "ndcg": "ndcg", "mrr": "reciprocal_rank", "chars": "chars"}
    return scores.groupBy(*by).agg(F.count("*").alias("questions"), *[F.avg(c).alias(n) for n, c in mean.items()], F.avg((F.col("recall") > 0).cast("double")).alias("found"))


def shares(counts: DataFrame, column: str = "n", floor: float = 1.5) -> DataFrame:
    """Each count as percent of all and of the greatest, and the width of its bar, ``floor`` percent at least."""
    top = counts.agg(F.sum(column).alias("__all"), F.max(column).alias("__most"))  # one row
    both = counts.join(F.broadcast(top))
    relative = 100.0 * F.col(column) / F.col("__most")
    return both.withColumn("share", 100.0 * F.col(column) / F.col("__all")).withColumn("relative", relative).withColumn("bar", F.greatest(relative, F.lit(floor))).drop("__all", "__most")
