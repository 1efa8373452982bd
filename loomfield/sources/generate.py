"""A synthetic graph of any size for load tests: every number is a hash of its row, so a table of 10^9 rows needs no driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Share of long links and seed of the generated graph.
LONG_LINKS, SEED = 0.15, 42
# End of fixed values.


def _unit(*parts) -> Column:
    """A number in (0, 1) from a row's own values and the seed."""
    return (F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def _name(i: Column) -> Column:
    return F.format_string("load-%010d", i)


def load_nodes(spark: SparkSession, n: int, domain: str = "load", width: int = 64) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, type, domain) and vectors (id, vector) of length one, from normal numbers of pairs of hashes."""
    rows = spark.range(n)
    nodes = rows.select(_name(F.col("id")).alias("id"), F.format_string("entity %d", "id").alias("name"), F.lit("concept").alias("type"), F.lit(domain).alias("domain"))
    normal = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda j: F.sqrt(-2 * F.log(_unit(F.col("id"), j, F.lit("r")))) * F.cos(2 * F.pi() * _unit(F.col("id"), j, F.lit("a"))))
    drawn = rows.select(_name(F.col("id")).alias("id"), normal.alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return nodes, drawn.withColumn("s", size).select("id", F.transform("v", lambda x: x / F.col("s")).alias("vector"))


def load_edges(spark: SparkSession, n: int, per_node: int = 3, domain: str = "load") -> DataFrame:
    """``per_node`` edges from each node: near ones to the next 50 ids, LONG_LINKS of them to any; loops become the next node."""
    rows = spark.range(n * per_node).select((F.col("id") / per_node).cast("long").alias("a"), F.pmod("id", F.lit(per_node)).alias("k"))
    far = _unit("a", "k", F.lit("far")) < LONG_LINKS
    step = F.floor(_unit("a", "k", F.lit("to")) * F.when(far, F.lit(n)).otherwise(F.lit(min(50, n)))) + 1
    to = F.pmod(F.col("a") + step, F.lit(n))
    to = F.when(to == F.col("a"), F.pmod(to + 1, F.lit(n))).otherwise(to)
    return rows.select(F.concat_ws("|", _name(F.col("a")), F.col("k").cast("string")).alias("id"), _name(F.col("a")).alias("source_id"), _name(to).alias("target_id"), F.lit("uses").alias("type"), (0.3 + 0.7 * _unit("a", "k", F.lit("w"))).alias("confidence"), F.lit(domain).alias("domain"))



def load_evidence(spark: SparkSession, n: int, domain: str = "load", width: int = 64) -> DataFrame:
    """A piece of evidence for each node (id, text, node_ids, vector, domain): it names the node and the next one."""
    _, vectors = load_nodes(spark, n, f"{domain} evidence", width)
    i = F.substring("id", 6, 10).cast("long")
    said = F.format_string("entity %d relates to topic %d and entity %d", i, i % 1000, (i + 1) % n)
    turned = F.transform("vector", lambda x, j: F.when(j % 2 == 0, x).otherwise(-x))
    return vectors.select(F.concat(F.lit("p-"), "id").alias("id"), said.alias("text"), F.array(F.col("id"), _name((i + 1) % n)).alias("node_ids"), turned.alias("vector"), F.lit(domain).alias("domain"))


def load_store(spark: SparkSession, n: int, domain: str = "load", width: int = 64):
    """The whole of a generated store: nodes, edges, vectors and evidence."""
    from loomfield.operators.field import Store

    nodes, vectors = load_nodes(spark, n, domain, width)
    return Store(nodes, load_edges(spark, n, domain=domain), vectors, load_evidence(spark, n, domain, width))
