"""Shared pieces: staged tables, bounded broadcasts, native word expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.sources.tables import WIDE_ROWS, delete, scope, scratch, staged  # noqa: F401

#: Separators of words: space and 0x09-0x0D.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"
#: A side of a join is broadcast when its counted rows stay below this; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has few rows (counted), else leave the join to shuffle with skew handling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """Mark ``df`` for a join by shuffle: a staged table that grows with the corpus may be small by its compressed files alone, by
    which Spark would send it whole through the driver."""
    return df.hint("merge")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; inside lambdas Spark would evaluate it again and again."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name
