"""Spans of patterns in whole texts with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Rule:
    """A kind of span: a Java pattern, a quick test that every text with a valid match passes, the group to judge."""

    kind: str
    pattern: str
    guard: str
    group: int = 0
    version: int = 1


def text_key(text: Column) -> Column:
    """Content address of a text; null is the empty text."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def matches(texts: DataFrame, rules: list[Rule], context: int = 0) -> DataFrame:
    """(blob, place, kind, start, end, whole, part, before, after): leftmost non-overlapping matches of each rule.

    ``texts`` has blob, text and todo (kinds to look for). Start and end count code points, end exclusive; ``place``
    is the rule's place in the list; ``before`` and ``after`` are up to ``context`` characters. The pieces between
    matches give the places: a running sum over the matches of one text and rule, which a long text bounds.
    """
    found = F.array(*[
        F.when(
            F.array_contains("todo", r.kind) & F.col("text").rlike(r.guard),
            F.struct(F.lit(i).alias("place"), F.lit(r.kind).alias("kind"), F.split("text", r.pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("whole"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)).alias("part")),
        )
        for i, r in enumerate(rules)
    ])
    per_rule = texts.select("blob", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("r"))
    row = per_rule.select("blob", "r.place", "r.kind", "r.gaps", F.posexplode(F.arrays_zip("r.whole", "r.part")).alias("i", "m"))
    row = row.select(
        "blob", "place", "kind", "i", F.col("m.whole").alias("whole"), F.col("m.part").alias("part"), F.length(F.get("gaps", F.col("i"))).alias("gap"),
        F.right(F.get("gaps", F.col("i")), F.lit(context)).alias("before") if context else F.lit("").alias("before"),
        F.left(F.get("gaps", F.col("i") + 1), F.lit(context)).alias("after") if context else F.lit("").alias("after"),
    )
    upto = Window.partitionBy("blob", "place").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    row = row.withColumn("end", F.sum(F.col("gap") + F.length("whole")).over(upto)).withColumn("start", F.col("end") - F.length("whole"))
    return row.select("blob", "place", "kind", "start", "end", "whole", "part", "before", "after")


def joined_spans(spans: Column) -> Column:
    """kind:start:end by start, then the kind's place, joined by commas; ``spans`` holds (start, place, kind, end)."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
