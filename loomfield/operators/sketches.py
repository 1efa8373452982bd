"""Mergeable percentiles: a KLL sketch for each bucket, stored once and merged over any range of buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; what it holds grows with the logarithm of its rows, never with them.
SIZE = 400


def rank_error(size: int = SIZE) -> float:
    """Share of the rows by which a quantile's rank may be off, with a confidence of 99 percent (the sketch's published fit)."""
    return 2.296 / size**0.9723


def sketched(df: DataFrame, *by: str, value: str, size: int = SIZE) -> DataFrame:
    """(by..., sketch, n): one sketch for each group, summed within tasks before the shuffle, so no group is gathered.

    Nulls are no values: ``n`` counts the others, and a group of nulls only has no row.
    """
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """(by..., sketch, n) over coarser groups: days into months, months into all."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def percentile(share: float, sketch: str = "sketch") -> Column:
    """The value at ``share`` of a sketch's rows."""
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(float(share)))


def rank_range(df: DataFrame, found: DataFrame, *by: str, value: str, column: str) -> DataFrame:
    """(by..., column_low, column_high): the shares of each group's rows below, and up to, the value that ``found`` has in ``column``."""
    seen = df.where(F.col(value).isNotNull()).join(found.select(*by, column), list(by))
    share = lambda hit: F.count_if(hit) / F.count(F.lit(1))
    return seen.groupBy(*by).agg(share(F.col(value) < F.col(column)).alias(f"{column}_low"), share(F.col(value) <= F.col(column)).alias(f"{column}_high"))
