"""One domain of a store at rest: each part laid out for what a question asks of it, so that a question reads little of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.domains import DEFAULT
from loomfield.operators import field, graph, postings, vector_index
from loomfield.sources import buckets


@dataclass(frozen=True)
class Standing:
    """What ``field.retrieve`` asks of a domain, answered from stored tables.

    ``names`` by id, ``edges`` by node (both directions), ``mentions`` by the node that is named, ``said`` by id; indexes over the
    vectors of nodes and evidence; postings of the evidence's words. ``probes`` and ``rerank`` are the vector searches' own.
    """

    names: buckets.Buckets
    edges: buckets.Buckets
    mentions: buckets.Buckets
    said: buckets.Buckets
    node_index: vector_index.VectorIndex
    evidence_index: vector_index.VectorIndex
    words: postings.Postings
    probes: int = 32
    rerank: int | None = 40

    def near_nodes(self, asked: DataFrame, k: int) -> DataFrame:
        return self.node_index.search(asked.select("query_id", "vector"), k, self.probes, self.rerank)

    def near_evidence(self, asked: DataFrame, k: int) -> DataFrame:
        return self.evidence_index.search(asked.select("query_id", "vector"), k, self.probes, self.rerank)

    def by_words(self, asked: DataFrame, k: int) -> DataFrame:
        return self.words.search(asked.select("query_id", "text"), k)

    def walk(self):
        return self.edges.of

    def named(self, ids: DataFrame) -> DataFrame:
        return self.names.of(ids)

    def naming(self, ids: DataFrame) -> DataFrame:
        return self.mentions.of(ids)

    def evidence(self, ids: DataFrame) -> DataFrame:
        return self.said.of(ids)


PARTS = ("names", "edges", "mentions", "said")


def create(store: field.Store, path: str, domain: str = DEFAULT, per_bucket: int = buckets.PER_BUCKET, cells: int | None = None, **search) -> Standing:
    """Lay out one domain of ``store`` under ``path``. Evidence without a vector or of another domain is not part of it."""
    own = field.Scanned(store.scoped(domain))
    walk = graph.ends(own.edges, "id", "source_id", "target_id", "w").withColumnRenamed("id", "edge")
    none = own.own.nodes.select("id").limit(0)
    for name, rows, key in (("names", own.named(none), "id"), ("edges", walk, "node"), ("mentions", own.naming(none), "node"), ("said", own.evidence(none), "id")):
        buckets.create(rows, key, f"{path}/{name}", per_bucket)
    vector_index.create(own.own.node_vectors.select("id", "vector"), f"{path}/node-vectors", cells)
    vector_index.create(own.own.propositions.select("id", "vector"), f"{path}/evidence-vectors", cells)
    postings.create(own.own.propositions.select("id", "text"), "id", "text", f"{path}/words", per_bucket=per_bucket)
    return opened(store.nodes.sparkSession, path, **search)


def opened(spark: SparkSession, path: str, **search) -> Standing:
    held = [buckets.opened(spark, f"{path}/{name}") for name in PARTS]
    return Standing(*held, vector_index.opened(spark, f"{path}/node-vectors"), vector_index.opened(spark, f"{path}/evidence-vectors"), postings.opened(spark, f"{path}/words"), **search)
