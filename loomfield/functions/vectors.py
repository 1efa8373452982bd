"""Vector expressions over ``array<float|double>``, inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product; unequal widths raise, null vectors give null."""
    total = F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    wrong = F.raise_error(F.concat(F.lit("vector widths differ: "), F.size(a), F.lit(" and "), F.size(b))).cast("double")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) != F.size(b), wrong).otherwise(total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector is similar to nothing (0), not NaN."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), scale))


def poincare_distance(u: Column, v: Column) -> Column:
    def square(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)

    apart = square(F.zip_with(u, v, lambda x, y: x - y))
    room = (1 - square(u)) * (1 - square(v)) + 1e-5
    return F.acosh(F.greatest(F.lit(1.0), 1 + 2 * apart / room))


def valid_vector(v: Column, width: int) -> Column:
    """Right width and only finite numbers; null is not valid."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == width) & finite, F.lit(False))
