"""An extractor without a model: named things, and sentences that state a relationship between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions.text import edge_type

# Verbs of a stated relationship, words that say of what type a thing is, and the confidences.
VERBS = "extends|improves on|improves|outperforms|introduces|proposes|presents|cites|is evaluated on|are evaluated on|is compared to|is trained on|is tested on|uses|is based on|builds on"
TYPES = [("dataset", "dataset|corpus|benchmark"), ("metric", "metric|score|accuracy"), ("paper", "paper|preprint"), ("method", "method|model|system|algorithm|network|approach")]
STATED = 0.8
# End of fixed values.

NAME = r"(?:[A-Z0-9][\w-]*)(?:\s+(?:[A-Z0-9][\w-]*|of|and(?=\s+[A-Z])))*"
SENTENCE = r"(?<=[.!?])\s+"


def _type(after: Column) -> Column:
    found = F.when(F.lit(False), "")
    for kind, pattern in TYPES:
        found = found.when(after.rlike(rf"(?i)^\s*(?:{pattern})s?\b"), kind)
    return found.otherwise("concept")


def by_rules(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (chunk, place, mention, type) and relations (chunk, place, subject, predicate, object, confidence, evidence) of (chunk, text).

    A relationship is a sentence in which a name, a verb of VERBS and another name follow each other; its ends are the
    entities, typed by the word after them. Inside Catalyst, without a shuffle; null and empty texts state nothing.
    """
    sentence = chunks.select("chunk", F.posexplode(F.split(F.coalesce("text", F.lit("")), SENTENCE)).alias("s", "said"))
    pattern = rf"\b({NAME})\s+({VERBS})\s+(?:the\s+|a\s+|an\s+)?({NAME})"
    parts = [F.regexp_extract_all("said", F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    met = sentence.select("chunk", "s", "said", F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abc")])).alias("i", "m"))
    rows = met.select("chunk", (F.col("s") * 100 + F.col("i")).alias("place"), F.col("m.a").alias("subject"), F.col("m.b").alias("predicate"), F.col("m.c").alias("object"), "said")
    relations = rows.select("chunk", "place", "subject", "predicate", "object", F.lit(STATED).alias("confidence"), F.trim("said").alias("evidence"))
    ends = F.array(*[F.struct((F.col("place") * 2 + i).alias("place"), F.col(c).alias("mention"), _type(F.expr(f"substring_index(said, {c}, -1)")).alias("type")) for i, c in enumerate(("subject", "object"))])
    return rows.select("chunk", F.inline(ends)), relations.withColumn("type", edge_type(F.col("predicate")))
