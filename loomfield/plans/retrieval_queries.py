"""Retrieval and evaluation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.functions.vectors import norm
from loomfield.operators import evaluation, retrieval
from loomfield.sources.tables import staged, table

K, DEPTH = 10, 100


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """The stated queries: every vector whose id is divisible by 20."""
    return _vectors(spark, sf).where("id % 20 = 0").select(F.col("id").cast("string").alias("query_id"), "vector")


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.nearest(_questions(spark, sf), _vectors(spark, sf), K)
    return found.select("query_id", "id", F.round("score", 5).alias("score"))


def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("id", F.round(norm(F.col("vector")), 5).alias("norm"))


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where("id % 20 = 0").select(F.col("id").cast("string").alias("query_id"), "label")


def same_label_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """How well the nearest vectors find those of the query's label: labels are compared, not listed."""
    rows = _vectors(spark, sf)
    found = retrieval.nearest(_questions(spark, sf), rows, K).join(rows.select("id", F.col("label").alias("own")), "id")
    judged = found.join(_asked(rows), "query_id").select("query_id", "rank", (F.col("own") == F.col("label")).alias("good"))
    sizes = _asked(rows).join(rows.groupBy("label").agg(F.count("*").alias("wanted")), "label").select("query_id", "wanted")
    scores = evaluation.judged_metrics(judged, sizes, K)
    return scores.select("query_id", *(F.round(c, 5).alias(c) for c in ("recall", "precision", "reciprocal_rank", "ndcg")))


def fused_rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest vectors, twice as heavy, fused with the first DEPTH vectors of the query's label by id."""
    rows = _vectors(spark, sf)
    near = retrieval.nearest(_questions(spark, sf), rows, K)
    firsts = rows.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where(F.col("place") <= DEPTH)
    alike = _asked(rows).join(firsts, "label").select("query_id", "id", (-F.col("id").cast("double")).alias("score"))
    lists = retrieval.ranked(near, "vector", 2.0).unionByName(retrieval.ranked(alike, "label", 1.0))
    return retrieval.fuse(lists).select("query_id", "id", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"), F.array_join("signals", ",").alias("signals"))


def compressed_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Five diverse ones out of the fused candidates of each question."""
    rows = _vectors(spark, sf)
    near = retrieval.nearest(_questions(spark, sf), rows, 50)
    chosen = near.select("query_id", "id", F.col("score").alias("relevance"), F.lit(1.0).alias("cost")).join(rows.select("id", "vector"), "id")
    return retrieval.compress(chosen, items=5)


def document_index(spark: SparkSession, sf: str) -> DataFrame:
    """Size of the inverted index: documents and occurrences of every term."""
    index = retrieval.lexical_index(table(spark, sf, "documents"), "doc_id", "text")
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def lexical_bm25(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.lexical(table(spark, sf, "documents"), "doc_id", "text", {"q": "the and"}, stemmed=False)
    return found.select("id", F.round("score", 5).alias("score"))


def pairs_of_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine between the mean vectors of labels: the label count bounds the pairs."""
    at = _vectors(spark, sf).select("label", F.posexplode("vector").alias("at", "x")).groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = staged(at.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v")), "label-means")
    asked = mean.select(F.col("label").cast("string").alias("query_id"), F.col("v").alias("vector"))
    every = retrieval.nearest(asked, mean.select(F.col("label").alias("id"), F.col("v").alias("vector")), mean.count())
    label = F.col("query_id").cast("int").alias("label")
    return every.where(F.col("query_id").cast("int") < F.col("id")).select(label, F.col("id").alias("other"), F.round("score", 5).alias("score"))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.latency(table(spark, sf, "events"), "event_type", column="value")


TOPK_SQL = f"""near AS MATERIALIZED (SELECT q.vec_id::VARCHAR AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 QUALIFY rank <= {K})"""
GOLD_SQL = "gold AS (SELECT q.vec_id::VARCHAR AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 20 = 0)"
WORDS_SQL = "words AS (SELECT doc_id AS id, term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')) AS term FROM documents) WHERE term <> '')"

QUERIES = {
    "cosine_topk": (cosine_topk, f"WITH {TOPK_SQL} SELECT query_id, id, round(score, 5) AS score FROM near"),
    "vector_norms": (vector_norms, "SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm FROM embeddings"),
    "same_label_metrics": (same_label_metrics, f"""WITH {TOPK_SQL}, {GOLD_SQL}, hits AS (SELECT n.query_id, count(*) AS n, count(g.id) AS hits, min(rank) FILTER (g.id IS NOT NULL) AS first,
      coalesce(sum(1 / log2(rank + 1)) FILTER (g.id IS NOT NULL), 0) AS gain FROM near n LEFT JOIN gold g USING (query_id, id) GROUP BY 1),
      sizes AS (SELECT query_id, count(*) AS wanted FROM gold GROUP BY 1)
      SELECT query_id, round(hits / wanted, 5) AS recall, round(hits / n, 5) AS "precision", round(coalesce(1.0::DOUBLE / first, 0), 5) AS reciprocal_rank,
      round(gain / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(wanted, {K}) + 1) t(i)), 5) AS ndcg FROM hits JOIN sizes USING (query_id)"""),
    "fused_rankings": (fused_rankings, f"""WITH {TOPK_SQL}, {GOLD_SQL}, lists AS (SELECT query_id, 'vector' AS signal, id, rank, 2.0::DOUBLE AS w FROM near UNION ALL
      SELECT query_id, 'label', id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS place, 1 FROM gold QUALIFY place <= {DEPTH}), f AS (SELECT query_id, id, sum(w / (60 + rank)) AS score, string_agg(signal, ',' ORDER BY signal) AS signals FROM lists GROUP BY 1, 2)
      SELECT query_id, id, round(score, 6) AS score, round(score / max(score) OVER (PARTITION BY query_id), 6) AS relevance, signals FROM f"""),
    "compressed_evidence": (compressed_evidence, None),
    "document_index": (document_index, f"WITH {WORDS_SQL} SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM words GROUP BY 1"),
    "lexical_bm25": (lexical_bm25, f"""WITH {WORDS_SQL}, lengths AS (SELECT id, count(*) AS length FROM words GROUP BY 1), tf AS (SELECT id, term, count(*) AS tf FROM words WHERE term IN ('the', 'and') GROUP BY 1, 2),
      df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), t AS (SELECT count(*) AS n, avg(length) AS mean FROM lengths)
      SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 5) AS score
      FROM tf JOIN df USING (term) JOIN lengths USING (id), t GROUP BY id HAVING count(*) = 2"""),
    "pairs_of_labels": (pairs_of_labels, """WITH m AS (SELECT label, list(x ORDER BY place) AS v FROM (SELECT label, place, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
      SELECT a.label, b.label AS other, round(list_cosine_similarity(a.v, b.v), 5) AS score FROM m a JOIN m b ON a.label < b.label"""),
    "latency_percentiles": (latency_percentiles, "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1"),
}
