"""Queries over stored tables and indexes, laid out from the driver's tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.operators import field, graph, postings, sketches, vector_index
from loomfield.plans.paper_queries import HOPS, SIZES_SQL
from loomfield.plans.retrieval_queries import K, TOPK_SQL
from loomfield.plans.views import edges, nodes
from loomfield.sources import buckets
from loomfield.sources.tables import scratch, staged, table

CELLS, BEST = 24, 5


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("type"))


def _asked(rows: DataFrame) -> DataFrame:
    """The stated queries: every vector whose id is divisible by 20."""
    return rows.where("id % 20 = 0").withColumn("query_id", F.col("id").cast("string")).drop("id")


def indexed_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors through a stored index whose every cell is probed and compared exactly."""
    rows = _vectors(spark, sf)
    index = vector_index.create(rows, scratch(spark, "vector-index"), CELLS)
    found = index.search(_asked(rows).drop("type"), K, probes=CELLS, rerank=None)
    return found.select("query_id", "id", F.round("score", 5).alias("score"))


def indexed_topk_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors of the question's own type, a condition inside the scan; codes choose, vectors decide."""
    rows = _vectors(spark, sf)
    index = vector_index.create(rows, scratch(spark, "vector-index"), CELLS)
    found = index.search(_asked(rows), K, probes=CELLS, rerank=1000)
    return found.select("query_id", "id", F.round("score", 5).alias("score"))


def postings_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best texts for the first two words of every twentieth document, through stored postings that skip blocks."""
    docs = table(spark, sf, "documents")
    first = F.split(F.coalesce("text", F.lit("")), " ")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").cast("string").alias("query_id"), F.concat_ws(" ", F.get(first, F.lit(0)), F.get(first, F.lit(1))).alias("text"))
    index = postings.create(docs, "doc_id", "text", scratch(spark, "postings"), stemmed=False)
    return index.search(asked, BEST).select("query_id", "id", F.round("score", 5).alias("score"))


def stored_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """``field_sizes`` over stored adjacency: each hop reads the buckets of its frontier."""
    links = edges(spark, sf).withColumn("w", F.col("confidence"))
    walk = graph.ends(links, "id", "source_id", "target_id", "w").withColumnRenamed("id", "edge")
    held = buckets.create(walk, "node", scratch(spark, "adjacency"), per_bucket=1 << 14)
    seeds = nodes(spark, sf).where("type = 'nation'").select(F.col("id").alias("query_id"), "id")
    near, _, cut = field.expand(seeds, held.of, HOPS, 40)
    sizes = near.groupBy("query_id").agg(F.count("*").alias("n"))
    return sizes.join(cut.withColumn("truncated", F.lit(True)), "query_id", "left").fillna({"truncated": False})


def bucketed_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """p50 and p95 of each event type from sketches of its days, merged; whether their ranks are within twice the sketch's error."""
    log = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    days = staged(sketches.sketched(log, "event_type", "day", value="value"), "sketches")
    found = sketches.merged(days, "event_type").withColumn("p50", sketches.percentile(0.5)).withColumn("p95", sketches.percentile(0.95))
    found = staged(found.select("event_type", "n", "p50", "p95"), "sketched-percentiles")
    slack, out = 2 * sketches.rank_error(), found.select("event_type", "n")
    for name, share in (("p50", 0.5), ("p95", 0.95)):
        rank = sketches.rank_range(log, found, "event_type", value="value", column=name)
        out = out.join(rank.select("event_type", ((F.col(f"{name}_low") <= share + slack) & (F.col(f"{name}_high") >= share - slack)).alias(f"{name}_holds")), "event_type")
    return out


QUERIES = {
    "bucketed_percentiles": (bucketed_percentiles, "SELECT event_type, count(value) AS n, true AS p50_holds, true AS p95_holds FROM events GROUP BY 1"),
    "indexed_topk": (indexed_topk, f"WITH {TOPK_SQL} SELECT query_id, id, round(score, 5) AS score FROM near"),
    "indexed_topk_by_type": (indexed_topk_by_type, f"""WITH near AS (SELECT q.vec_id::VARCHAR AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
      FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) <= {K})
      SELECT query_id, id, round(score, 5) AS score FROM near"""),
    "postings_topk": (postings_topk, f"""WITH words AS MATERIALIZED (SELECT doc_id AS id, term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents) WHERE term <> ''),
      asked AS MATERIALIZED (SELECT DISTINCT query_id, term FROM (SELECT doc_id::VARCHAR AS query_id, unnest(regexp_split_to_array(lower(split_part(coalesce(text, ''), ' ', 1) || ' ' || split_part(coalesce(text, ''), ' ', 2)), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents WHERE doc_id % 20 = 0) WHERE term <> ''),
      need AS (SELECT query_id, count(*) AS terms FROM asked GROUP BY 1), lengths AS MATERIALIZED (SELECT id, count(*) AS length FROM words GROUP BY 1), t AS (SELECT count(*) AS n, avg(length) AS mean FROM lengths),
      tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
      scored AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 12) AS score
        FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lengths USING (id) JOIN need USING (query_id), t GROUP BY query_id, id HAVING count(*) = any_value(terms))
      SELECT query_id, id, round(score, 5) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {BEST}"""),
    "stored_sizes": (stored_sizes, SIZES_SQL),
}
