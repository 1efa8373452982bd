"""What a caller asks of one store, each method a composition of operators; domains are resolved strictly."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.domains import Registry
from loomfield.functions.vectors import valid_vector
from loomfield.operators import browse, evalset, graph
from loomfield.operators import field as retrieval


@dataclass
class Field:
    """The five questions an agent may ask, over a store and its registry of domains."""

    store: retrieval.Store
    registry: Registry = field(default_factory=Registry)
    width: int = 768

    def search_knowledge(self, questions: list[str], domain: str | None = None, options: retrieval.Options = retrieval.Options()) -> retrieval.Answer:
        """Evidence for each question; the question's place is its id, its vector the hashed embedding."""
        spark = self.store.nodes.sparkSession
        asked = spark.createDataFrame([(str(i), q) for i, q in enumerate(questions)], "query_id string, text string")
        return retrieval.retrieve(self.store, asked.join(evalset.vectors(asked, "query_id", "text"), "query_id"), self.registry.resolve(domain), options)

    def query_field(self, questions: list[str], domain: str | None = None) -> DataFrame:
        """(query_id, context): numbered evidence, ready to be put into words by whoever has a model."""
        return retrieval.context(self.search_knowledge(questions, domain).evidence)

    def find_entity(self, text: str, domain: str | None = None, limit=10) -> DataFrame:
        found = browse.search(self.registry.scope(self.store.nodes, domain), text)
        return browse.page(found, [F.length("name"), "name", "id"], limit)[0]

    def get_subgraph(self, node: str, hops=2, domain: str | None = None) -> tuple[DataFrame, DataFrame]:
        own = self.store.scoped(self.registry.resolve(domain))
        return graph.subgraph(own.nodes, own.edges, own.nodes.where(F.col("id") == node), browse.bounded(hops, 2, 1, 3))

    def list_domains(self) -> list[str]:
        return sorted(self.registry.domains)

    def health(self) -> DataFrame:
        """(name, rows, unfit): the tables of the store, and how many vectors are of a wrong width or hold other than finite numbers."""
        sizes = [df.agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.lit(0).cast("long").alias("unfit")) for n, df in (("nodes", self.store.nodes), ("edges", self.store.edges))]
        wrong = F.count_if(~valid_vector(F.col("vector"), self.width))
        sizes += [df.agg(F.lit(n).alias("name"), F.count("*").alias("rows"), wrong.alias("unfit")) for n, df in (("node_vectors", self.store.node_vectors), ("propositions", self.store.propositions))]
        out = sizes[0]
        for df in sizes[1:]:
            out = out.unionByName(df)
        return out
