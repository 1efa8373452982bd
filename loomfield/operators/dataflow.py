"""Job queues, leases, retries and rate limits, as folds over snapshots and event logs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.sources.tables import staged

#: Claims after which a job fails instead of returning to the queue.
MAX_CLAIMS = 25
#: Failures after which a job is given up, and what an old accounting of claims left as its error.
MAX_FAILURES = 3
MISCOUNTED = "Interrupted and out of retry attempts"
TERMINAL = ("completed", "failed")
#: Seconds of a lease, and how many jobs a lane runs at once.
LEASE = 120
WIDTHS = {"ingest": 2, "process": 1, "other": 1}
LIVE = ("queued", "running", "paused")


def keep_one_live_job(jobs: DataFrame, key: str) -> DataFrame:
    """The live jobs that survive one-per-key: owned first, then oldest, then least id."""
    order = Window.partitionBy(key).orderBy(F.col("owner").isNull(), "created_at", "id")
    return jobs.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def queue_position(jobs: DataFrame, lane: str) -> DataFrame:
    """Queued jobs numbered from 1 in each lane, oldest first.

    Lanes are few and one may hold most jobs, so no task takes a whole lane: jobs are dealt by ranges of (lane, age), each
    range numbers its own, and what the ranges before hold of a lane is added (a row for each range and lane).
    """
    order = [F.col(lane), F.col("created_at"), F.col("id")]
    dealt = staged(jobs.where(F.col("owner").isNull()).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "queue")
    sizes = dealt.groupBy(lane, "__range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(lane).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col(lane).alias("__lane"), F.col("__range").alias("__at"), F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(lane, "__range").orderBy("created_at", "id"))
    placed = dealt.withColumn("__place", place).join(offsets, F.col(lane).eqNullSafe(F.col("__lane")) & (F.col("__range") == F.col("__at")))
    return placed.withColumn("position", (F.col("__place") + F.col("__before")).cast("int")).select(*jobs.columns, "position")


def claim(jobs: DataFrame, lane: str, width: Column | int = 1) -> DataFrame:
    """The next jobs of each lane, first in first out, up to the lane's width."""
    order = Window.partitionBy(lane).orderBy("created_at", "id")  # tasks cut their own part of a lane before the shuffle
    return jobs.where(F.col("owner").isNull()).withColumn("position", F.row_number().over(order)).where(F.col("position") <= width)


def leased(jobs: DataFrame, ids: DataFrame, owner: str, now: Column, seconds: int = LEASE) -> DataFrame:
    """Jobs after ``owner`` claims those of ``ids`` (id): running, one more claim, a lease of ``seconds``; only queued ones without an
    owner can be claimed, so of two claims the second takes nothing."""
    asked = F.coalesce(F.col("__asked") & F.col("owner").isNull() & (F.col("status") == "queued"), F.lit(False))
    new = {"owner": F.lit(owner), "status": F.lit("running"), "attempts": F.col("attempts") + 1, "lease_expires_at": F.timestamp_add("SECOND", F.lit(seconds), now)}
    marked = jobs.join(ids.select("id").distinct().withColumn("__asked", F.lit(True)), "id", "left").withColumn("__asked", asked)
    return marked.select(*[F.when(F.col("__asked"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def heartbeat(jobs: DataFrame, owner: str, now: Column, seconds: int = LEASE) -> DataFrame:
    """Jobs after their owner shows that it lives: its running jobs' leases start anew."""
    own = F.coalesce((F.col("owner") == owner) & (F.col("status") == "running"), F.lit(False))
    return jobs.withColumn("lease_expires_at", F.when(own, F.timestamp_add("SECOND", F.lit(seconds), now)).otherwise(F.col("lease_expires_at")))


def swept(jobs: DataFrame, owner: str, now: Column) -> DataFrame:
    """Jobs after an owner starts again: what it still held, and every expired lease, returns to the queue or fails."""
    lost = F.coalesce((F.col("owner") == owner) & (F.col("status") == "running"), F.lit(False))
    return reap(jobs.withColumn("lease_expires_at", F.when(lost, F.timestamp_add("SECOND", F.lit(-1), now)).otherwise(F.col("lease_expires_at"))), now)


def chained(finished: DataFrame) -> DataFrame:
    """The processing job that follows each completed ingest job (id, type, status, paper_id); ids come from the paper, so it is one."""
    done = finished.where("type = 'ingest' and status = 'completed' and paper_id is not null").select("paper_id").distinct()
    return done.select(F.concat(F.lit("process-"), F.col("paper_id").cast("string")).alias("id"), F.lit("process").alias("type"), F.lit("queued").alias("status"), "paper_id")


def reap(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs after their leases are checked: expired ones return to the queue, or fail after MAX_CLAIMS claims."""
    lapsed = F.coalesce((F.col("status") == "running") & (F.col("lease_expires_at") < now), F.lit(False))
    spent = F.col("attempts") >= MAX_CLAIMS
    status = F.when(lapsed & spent, "failed").when(lapsed, "queued").otherwise(F.col("status"))
    return jobs.withColumn("owner", F.when(lapsed, F.lit(None)).otherwise(F.col("owner"))).withColumn("status", status)


def unfinished_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks without a checkpoint of the same content."""
    return chunks.join(done, ["paper_id", "chunk_index", "content_hash"], "left_anti")


def rate_limit(events: DataFrame, key: str, seconds: Column, window: int, limit: int) -> DataFrame:
    """Whether each event is within ``limit`` for its key and aligned window of ``window`` seconds."""
    slot = F.floor(seconds / window)
    place = F.row_number().over(Window.partitionBy(key, "slot").orderBy("at", "event_id"))
    return events.withColumn("at", seconds).withColumn("slot", slot).withColumn("place", place).withColumn("allowed", F.col("place") <= limit)


def failure_runs(log: DataFrame, key: str, order: str, failed: Column, resets: Column) -> DataFrame:
    """(key, longest): the longest run of ``failed`` entries; only entries that reset end a run, others (successes) do not."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    runs = log.withColumn("bad", failed).withColumn("run", F.sum((resets & ~F.col("bad")).cast("long")).over(w))
    return runs.groupBy(key, "run").agg(F.count_if("bad").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def anchored_windows(events: DataFrame, key: str, seconds: Column, window: float, limit: int) -> DataFrame:
    """Each event with (window_start, place, allowed, remaining, reset): windows of a key start at its first event after the
    one before has ended, not at multiples of ``window``.

    Where a window starts depends on all windows before it, so a key's events pass one worker in order of (time, event_id); they
    stream through it with one window as its whole state, never gathered. Null keys are a key of their own.
    """
    timed = events.withColumn("at", seconds.cast("double"))
    columns = timed.schema.add("window_start", "double").add("place", "long").add("allowed", "boolean").add("remaining", "long").add("reset", "double")

    def fold(batches):
        held = (object(), 0.0, 0)  # key, start of its window, events in it
        for b in batches:
            keys, at = b.column(key).to_pylist(), b.column("at").to_numpy(zero_copy_only=False)
            start, place = np.empty(len(at)), np.empty(len(at), np.int64)
            for i, (k, t) in enumerate(zip(keys, at, strict=True)):
                name, begun, n = held
                held = (k, t, 1) if k != name or t >= begun + window else (k, begun, n + 1)
                start[i], place[i] = held[1], held[2]
            extra = [pa.array(start), pa.array(place), pa.array(place <= limit), pa.array(np.maximum(limit - place, 0)), pa.array(start + window)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=columns.names)

    return timed.repartition(F.col(key)).sortWithinPartitions(F.col(key), "at", "event_id").mapInArrow(fold, columns)


def after_attempts(log: DataFrame) -> DataFrame:
    """(job, failures, claims, status) from a log of (job, outcome): claimed, completed, failed, permanent or interrupted.

    Only failures of the work count against it; a permanent one ends it at once, MAX_FAILURES others too; interruptions cost
    nothing until there are MAX_CLAIMS claims.
    """
    n = lambda *what: F.count_if(F.col("outcome").isin(*what))
    seen = log.groupBy("job").agg(n("failed", "permanent").alias("failures"), n("claimed").alias("claims"), n("permanent").alias("__p"), n("completed").alias("__c"))
    over = (F.col("__p") > 0) | (F.col("failures") >= MAX_FAILURES) | (F.col("claims") >= MAX_CLAIMS)
    return seen.select("job", "failures", "claims", F.when(F.col("__c") > 0, "completed").when(over, "failed").otherwise("queued").alias("status"))


def requeued(jobs: DataFrame) -> DataFrame:
    """Jobs (status, owner, lease_expires_at, attempts, error) that an old accounting failed without an error, back in the queue."""
    wrong = F.coalesce((F.col("status") == "failed") & F.col("error").startswith(MISCOUNTED), F.lit(False))
    new = {"status": F.lit("queued"), "owner": F.lit(None), "lease_expires_at": F.lit(None), "attempts": F.lit(0), "error": F.lit("requeued")}
    return jobs.withColumns({c: F.when(wrong, v).otherwise(F.col(c)) for c, v in new.items()})


def batch_progress(jobs: DataFrame, batch: str, statuses: tuple[str, ...]) -> DataFrame:
    """One row for each batch: a count for each status, ``total`` and ``complete`` (all completed or failed; paused is not)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    done = F.count_if(F.col("status").isin(*TERMINAL))
    return jobs.groupBy(batch).agg(*counts, F.count("*").alias("total"), (done == F.count("*")).alias("complete"))


def admitted(batches: DataFrame, pending: int, most: int = 500) -> DataFrame:
    """(batch, incoming, admitted): whether each asked batch alone fits beside the pending jobs."""
    return batches.withColumn("admitted", F.col("incoming") + pending <= most)


def until_paused(chunks: DataFrame, pauses: DataFrame) -> DataFrame:
    """Chunks (paper_id, chunk_index, started_at) that began before their paper was paused (paper_id, paused_at): a pause is seen
    between chunks, and a chunk that has begun is finished."""
    first = pauses.groupBy("paper_id").agg(F.min("paused_at").alias("__paused"))
    return chunks.join(first, "paper_id", "left").where(F.col("__paused").isNull() | (F.col("started_at") < F.col("__paused"))).drop("__paused")
