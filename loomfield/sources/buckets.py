"""Stored tables that answer for a few keys without reading the rest: rows hashed by key into folders, sorted, behind a manifest."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.sources.tables import release, scope, staged

#: Rows of one bucket, about; a table has as many buckets as its first rows ask for.
PER_BUCKET = 1 << 20
#: Keys that are pushed into the scan one by one; with more, only their buckets are.
LOOKUP = 1024
#: Buckets that are named to the scan; beyond it a join on the bucket picks them.
NAMED = 10_000


def publish(spark: SparkSession, path: str, key: str, buckets: int, segments: list[str], version: int) -> None:
    """Make ``segments`` what readers see, at once: the newest row of the manifest holds. One writer at a time."""
    row = [(version, key, buckets, segments)]
    spark.createDataFrame(row, "version bigint, key string, buckets int, segments array<string>").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


@dataclass(frozen=True)
class Buckets:
    """A stored table of ``segments``, each a folder of its own with a folder for each bucket that has rows."""

    spark: SparkSession
    path: str
    key: str
    buckets: int
    segments: tuple[str, ...]
    version: int

    @property
    def rows(self) -> DataFrame:
        """All rows, with their ``bucket``."""
        found = None
        for s in self.segments:
            part = self.spark.read.parquet(f"{self.path}/{s}")
            found = part if found is None else found.unionByName(part)
        return found

    def of(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is the only column of ``keys``: just the buckets of these keys are read, whatever the table's size."""
        name = keys.columns[0]
        keys = keys.select(F.col(name).alias("wanted")).where("wanted is not null").distinct()
        few = keys.limit(LOOKUP + 1).collect()  # at most LOOKUP + 1 keys
        rows = self.rows
        if len(few) <= LOOKUP:
            names = [r["wanted"] for r in few]
            places = {r["b"] for r in keys.select(hashed(F.col("wanted"), self.buckets).alias("b")).distinct().collect()} if names else set()
            return rows.where(F.col("bucket").isin(sorted(places)) & F.col(self.key).isin(names)).drop("bucket")
        keys = keys.withColumn("bucket", hashed(F.col("wanted"), self.buckets))
        if self.buckets <= NAMED:
            rows = rows.where(F.col("bucket").isin(sorted(r["bucket"] for r in keys.select("bucket").distinct().collect())))
        return rows.join(keys, (rows["bucket"] == keys["bucket"]) & (rows[self.key] == keys["wanted"]), "left_semi").drop("bucket")

    def files(self, keys: DataFrame) -> DataFrame:
        """(file, bytes) that ``of`` opens for the keys, for measuring."""
        places = [r["b"] for r in keys.select(hashed(F.col(keys.columns[0]), self.buckets).alias("b")).distinct().collect()]
        found = None
        for s in self.segments:
            part = self.spark.read.parquet(f"{self.path}/{s}").where(F.col("bucket").isin(places)).select("_metadata.file_path", "_metadata.file_size")
            found = part if found is None else found.union(part)
        return found.distinct().select(F.col("file_path").alias("file"), F.col("file_size").alias("bytes"))

    def append(self, rows: DataFrame) -> Buckets:
        """The table with ``rows`` added, as a segment of their own; what has been written before is not touched."""
        with _once(rows) as held:
            return _published(replace(self, segments=(*self.segments, _written(held, self.path, self.key, self.buckets)), version=self.version + 1))

    def replaced(self, rows: DataFrame, buckets: int | None = None) -> Buckets:
        """The table with ``rows`` in place of all segments; the old ones stay for readers that hold them."""
        n = buckets or self.buckets
        with _once(rows) as held:
            return _published(replace(self, buckets=n, segments=(_written(held, self.path, self.key, n),), version=self.version + 1))


@contextmanager
def _once(rows: DataFrame) -> Iterator[DataFrame]:
    """``rows`` computed once, as a table that goes with the block; the shuffles that made it go before it is dealt out."""
    with scope(rows.sparkSession) as own:
        held = staged(rows, "bucket-rows")
        release(rows.sparkSession)
        yield held
        own.forget()


def hashed(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _written(rows: DataFrame, path: str, key: str, buckets: int) -> str:
    """A new segment: range-sorted by bucket and key, so that a hot key's rows are spread over tasks and files.

    ``rows`` are read twice, to find the ranges and to deal them out, so they are a written table.
    """
    name = f"segment-{uuid.uuid4().hex}"
    rows = rows.withColumn("bucket", hashed(F.col(key), buckets))
    salt = F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind])
    rows.repartitionByRange("bucket", key, salt).sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{path}/{name}")
    return name


def _published(table: Buckets) -> Buckets:
    publish(table.spark, table.path, table.key, table.buckets, list(table.segments), table.version)
    return table


def create(rows: DataFrame, key: str, path: str, per_bucket: int = PER_BUCKET) -> Buckets:
    """Store ``rows`` under ``path`` by ``key``. A null key is stored but never found."""
    with _once(rows) as held:
        buckets = max(1, -(-held.count() // per_bucket))
        return _published(Buckets(rows.sparkSession, path, key, buckets, (_written(held, path, key, buckets),), 1))


def opened(spark: SparkSession, path: str) -> Buckets:
    """The table as its newest manifest row has it."""
    at = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
    return Buckets(spark, path, at["key"], at["buckets"], tuple(at["segments"]), at["version"])
