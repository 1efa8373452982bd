"""Reading tables, and staging intermediate ones in the shared folder."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows of one task, about, where a step's tasks follow the number of its rows.
TASK_ROWS = 250_000
#: For rows of a megabyte or so: row groups, which a writer and a reader hold whole, and pages close by their bytes after every row,
#: not at the hundredth row first.
WIDE_ROWS = {"parquet.block.size": str(1 << 24), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Folders of staged tables that this process wrote and has not deleted yet, in the order written.
_written: list[str] = []


class Scope:
    """What one caller has staged since it opened the scope, and nobody else: other threads and earlier results are not in it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def forget(self, but: int = 0) -> None:
        """Delete what was staged in the scope, the last ``but`` tables excepted; no later plan may read them."""
        gone = self.paths[: len(self.paths) - but]
        self.paths = self.paths[len(self.paths) - but :]
        for path in gone:
            if path in _written:
                _written.remove(path)
            delete(self.spark, path)


_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Collect what this thread stages inside the block."""
    own = Scope(spark)
    held = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame) -> int:
    """Tasks for steps over as many rows as a stored table has (counted from its footers), so that what one of them holds does not grow."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt out by their keys to a number of tasks; None leaves it to Spark."""
    return df if parts is None else df.repartition(parts, *keys)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="loomfield-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by the scope it was taken in, or when the process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_forget_all, spark)
    _written.append(path)
    if _scope.get() is not None:
        _scope.get().paths.append(path)
    return path


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Written as Parquet to the shared folder and read again: ends the lineage, and outlives lost executors.

    What is staged is deleted by its ``scope``, or when the process ends. ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget_all(spark: SparkSession) -> None:
    try:
        while _written:
            delete(spark, _written.pop())
    except Exception:  # the JVM has gone first; the folder is the caller's to clear
        pass
