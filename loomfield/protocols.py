"""What can be plugged in: each is a function from DataFrame to DataFrame, so that plans stay whole."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from loomfield.functions import text


class Extractor(Protocol):
    """(chunk, text) to entities (chunk, place, mention, type) and relations (chunk, place, subject, predicate, object, confidence, evidence)."""

    def __call__(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]: ...


class Embedder(Protocol):
    """A keyed text table to (key, vector)."""

    def __call__(self, rows: DataFrame, key: str, text: str) -> DataFrame: ...


class CandidateSource(Protocol):
    """(mention_id, name, vector) to near candidates (mention_id, id, score)."""

    def __call__(self, mentions: DataFrame) -> DataFrame: ...


class Strategy(Protocol):
    """A store, questions, a domain and k to (query_id, id, rank, chars)."""

    def __call__(self, store, questions: DataFrame, domain: str, k: int) -> DataFrame: ...


class Handler(Protocol):
    """A batch of events of a stream, with its number; a batch may come again after a failure."""

    def __call__(self, events: DataFrame, number: int) -> None: ...


def register_functions(spark: SparkSession) -> list[str]:
    """The name and type ladders as temporary SQL functions of the session, for those who write SQL."""

    def cases(steps, value: str, otherwise: str) -> str:
        return "CASE " + " ".join(f"WHEN {value} RLIKE '{pattern}' THEN '{label}'" for label, pattern in steps) + f" ELSE {otherwise} END"

    bodies = {
        "normalise_name": "lower(trim(x))",
        "entity_type": "CASE lower(trim(coalesce(x, ''))) WHEN 'paper_reference' THEN 'paper' WHEN '' THEN 'concept' ELSE lower(trim(x)) END",
        "edge_type": "CASE WHEN trim(coalesce(x, '')) RLIKE '^[a-z][a-z0-9_]*$' THEN trim(x) ELSE " + cases(text.EDGE_TYPES, "lower(coalesce(x, ''))", "'uses'") + " END",
        "edge_role": "CASE WHEN x = 'mentions' THEN 'covers' ELSE " + cases(text.ROLES, "lower(x)", "'covers'") + " END",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
    return sorted(bodies)
