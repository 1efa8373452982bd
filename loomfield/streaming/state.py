"""Keyed state with timers: live leases of jobs and rate windows as running streams, each with the fold over a table that it equals."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from loomfield.operators.dataflow import LEASE, MAX_CLAIMS, MAX_FAILURES
from loomfield.streaming import events

#: A job after an event: how it stands, who runs it until when (seconds), what it has cost; ``seq`` numbers its changes.
JOB = "status string, owner string, lease double, claims int, failures int, seq bigint"
CHANGE = f"job string, at double, {JOB}"
NEW = ("queued", None, None, 0, 0, 0)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lapsed(job: tuple, now: float) -> tuple | None:
    """A running job after its lease has ended before ``now``: back in the queue, or failed after MAX_CLAIMS claims."""
    status, _, lease, claims, failures, seq = job
    if status != "running" or lease >= now:
        return None
    return ("failed" if claims >= MAX_CLAIMS else "queued", None, None, claims, failures, seq + 1)


def changed(job: tuple | None, kind: str, owner: str | None, at: float, seconds: float = LEASE) -> tuple | None:
    """A job after one event, None if the event changes nothing.

    enqueue makes a job, or a new one where the last has ended; claim runs a queued one; heartbeat, complete, fail and permanent
    count only from the owner that runs it. MAX_FAILURES failures or a permanent one end a job.
    """
    if job is None or job[0] in ("completed", "failed"):
        return (*NEW[:5], (job[5] if job else 0) + 1) if kind == "enqueue" else None
    status, held, lease, claims, failures, seq = job
    if kind == "claim":
        return ("running", owner, at + seconds, claims + 1, failures, seq + 1) if status == "queued" else None
    if status != "running" or owner != held:
        return None
    if kind == "heartbeat":
        return (status, held, at + seconds, claims, failures, seq + 1)
    if kind == "complete":
        return ("completed", None, None, claims, failures, seq + 1)
    if kind in ("fail", "permanent"):
        over = kind == "permanent" or failures + 1 >= MAX_FAILURES
        return ("failed" if over else "queued", None, None, claims, failures + 1, seq + 1)
    return None


def steps(job: tuple | None, rows, seconds: float = LEASE) -> Iterator[tuple[float, tuple]]:
    """(at, job) of every change by rows (at, kind, owner) in order of time; a lease that ended before a row ends first."""
    for at, kind, owner in rows:
        over = lapsed(job, at) if job else None
        if over:
            yield job[2], over
            job = over
        new = changed(job, kind, owner, at, seconds)
        if new:
            yield at, new
            job = new


class Leases(StatefulProcessor):
    """A job's state as one value; a timer at the end of its lease lapses it when no event does."""

    def __init__(self, seconds: float = LEASE):
        self.seconds = seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)

    def _put(self, job: tuple) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.job.update(job)
        if job[0] == "running":
            self.handle.registerTimer(int(job[2] * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        job = tuple(self.job.get()) if self.job.exists() else None
        last = None
        for at, new in steps(job, sorted(((r["at"], r["kind"], r["owner"]) for r in rows), key=lambda r: r[0]), self.seconds):
            last = new
            yield Row(job=key[0], at=at, **dict(zip(("status", "owner", "lease", "claims", "failures", "seq"), new, strict=True)))
        if last:
            self._put(last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job = tuple(self.job.get())
        over = lapsed(job, expiredTimerInfo.getExpiryTimeInMs() / 1000)
        if over:
            self._put(over)
            yield Row(job=key[0], at=job[2], **dict(zip(("status", "owner", "lease", "claims", "failures", "seq"), over, strict=True)))

    def close(self) -> None:
        pass


class Windows(StatefulProcessor):
    """A key's open rate window: its start and how many events it has had; a timer drops it once it has ended."""

    def __init__(self, window: float, limit: int, output: list[str]):
        self.window, self.limit, self.output = window, limit, output

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start double, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = tuple(self.open.get()) if self.open.exists() else None
        for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
            held = (r["at"], 1) if held is None or r["at"] >= held[0] + self.window else (held[0], held[1] + 1)
            made = {"window_start": held[0], "place": held[1], "allowed": held[1] <= self.limit, "remaining": max(self.limit - held[1], 0), "reset": held[0] + self.window}
            yield Row(**{c: made[c] if c in made else r[c] for c in self.output})
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.open.update(held)
        self.handle.registerTimer(int((held[0] + self.window) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.open.clear()
        return iter([])

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside the block keep their state in RocksDB, which keyed state with timers needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, held) if held else spark.conf.unset(name)


def lease_changes(stream: DataFrame, late: str = "1 minute", seconds: float = LEASE) -> DataFrame:
    """CHANGE rows of a stream of (job, ts, at, kind, owner); ``at`` is ``ts`` in seconds. Run it inside ``rocks``.

    An event-time timer lapses a lease once the watermark, ``late`` behind the newest event, has passed its end. A batch's events of a
    job go by time; events behind the watermark are dropped.
    """
    keyed = stream.withWatermark("ts", late).groupBy("job")
    return keyed.transformWithState(Leases(seconds), outputStructType=CHANGE, outputMode="append", timeMode="eventTime")


def rate_windows(stream: DataFrame, key: str, window: float, limit: int, late: str = "1 minute") -> DataFrame:
    """``dataflow.anchored_windows`` of a stream with ts, at and event_id: windows of a key start at its first event after the last has ended."""
    output = StructType(stream.schema.fields).add("window_start", "double").add("place", "long").add("allowed", "boolean").add("remaining", "long").add("reset", "double")
    keyed = stream.withWatermark("ts", late).groupBy(key)
    return keyed.transformWithState(Windows(window, limit, output.names), outputStructType=output, outputMode="append", timeMode="eventTime")


def run(stream: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """``events.run_to_end`` with keyed state; with ``root`` a later run goes on where an earlier one of the same folder ended."""
    with rocks(stream.sparkSession):
        return events.run_to_end(stream, name, root=root)


def latest(changes: DataFrame) -> DataFrame:
    """How each job stands: its last change."""
    row = F.struct(*[c for c in changes.columns if c != "job"])
    return changes.groupBy("job").agg(F.max_by(row, "seq").alias("row")).select("job", "row.*")


def folded(log: DataFrame, until: float | None = None, seconds: float = LEASE) -> DataFrame:
    """CHANGE rows of a table of (job, at, kind, owner): a job's events pass one worker in order of time, its state is all that is held.

    Leases that end before ``until`` lapse although no event follows.
    """

    def run(batches):
        job, state, out = None, None, []

        def ended():
            over = lapsed(state, until) if state and until is not None else None
            return [(job, state[2], *over)] if over else []

        for b in batches:
            out = []
            for name, at, kind, owner in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if name != job:
                    out += ended()
                    job, state = name, None
                for when, new in steps(state, [(at, kind, owner)], seconds):
                    out.append((job, when, *new))
                    state = new
            yield _batch(out)
        yield _batch(ended())

    return log.select("job", "at", "kind", "owner").repartition("job").sortWithinPartitions("job", "at").mapInArrow(run, CHANGE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.float64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64()]
    names = ["job", "at", "status", "owner", "lease", "claims", "failures", "seq"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
