"""Named queries over the driver's tables and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import engine, graph_queries, paper_queries, retrieval_queries, standing_queries, store_queries, stream_queries, text_queries

MODULES = (graph_queries, paper_queries, retrieval_queries, text_queries, store_queries, standing_queries, stream_queries, engine)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Mass of a personalized walk from one region over the whole graph."""
    return graph_queries.ppr_region(spark, sf)


def queries() -> dict:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
