"""Streams of events: windowed counts with late data, a first-event log without repeats, and runs that end when all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.sources.tables import scratch


def event_stream(spark: SparkSession, folder: str, name: str, files_at_once: int = 8) -> DataFrame:
    """``folder``/``name``.parquet as a stream; no trigger reads more than ``files_at_once`` files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def windowed_counts(events: DataFrame, at: str, key: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(key, start, n): counts of each key in tumbling windows, or sliding ones; state of a window goes ``late`` after it."""
    slot = F.window(at, length, slide) if slide else F.window(at, length)
    return events.withWatermark(at, late).groupBy(key, slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("slot.start").alias("start"), "n")


def session_counts(events: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, start, n): counts of each key's sessions, which end after ``gap`` without events."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("slot")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("slot.start").alias("start"), "n")


def once_each(events: DataFrame, at: str, key: str, late: str = "1 hour") -> DataFrame:
    """Events without repeats of ``key`` that come within ``late`` of each other; state stays bounded."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def publish(stream: DataFrame, name: str, handlers: list) -> None:
    """Hand each batch of a stream to all handlers (batch, number) until all is read; a batch that failed comes again whole."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        for handler in handlers:
            handler(batch, number)

    root = scratch(spark, name)
    stream.writeStream.option("checkpointLocation", root).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def run_to_end(stream: DataFrame, name: str, keys: list[str] | None = None, root: str | None = None) -> DataFrame:
    """Read all there is, then stop; what the stream put out, as a table in the shared folder.

    Each batch writes a folder of its own number, so a batch that is run again after a failure replaces its rows.
    With ``keys`` the stream puts out updated rows and the latest batch's row of each key counts; else rows are final. A run in the
    folder ``root`` goes on where the last one there ended, and gives the rows of both.
    """
    spark = stream.sparkSession
    root = root or scratch(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/number={number}")

    query = stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    kept = stream.columns
    out = spark.read.parquet(f"{root}/out")
    if not keys:
        return out.select(*kept)
    row = F.max_by(F.struct(*kept), "batch").alias("row")
    return out.groupBy(*keys).agg(row).select("row.*")
