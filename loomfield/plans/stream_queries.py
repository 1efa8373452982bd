"""Structured Streaming over the driver's events, run until all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.streaming import events, state


def _stamped(spark: SparkSession, sf: str) -> DataFrame:
    return events.event_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _seconds(found: DataFrame) -> DataFrame:
    return found.withColumn("start", F.unix_timestamp("start"))


def stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    counts = events.windowed_counts(_stamped(spark, sf), "ts", "event_type", "1 hour")
    return _seconds(events.run_to_end(counts, "hourly", ["event_type", "start"]))


def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    counts = events.windowed_counts(_stamped(spark, sf), "ts", "event_type", "2 hours", "1 hour")
    return _seconds(events.run_to_end(counts, "sliding", ["event_type", "start"]))


def stream_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The audit log: purchases and errors, each event once."""
    log = events.once_each(_stamped(spark, sf).where("event_type IN ('purchase', 'error')"), "ts", "event_id")
    return events.run_to_end(log.select("event_id", "user_id", "event_type"), "audit")


#: Event types as what happens to the job of a user; an owner has every other five events.
KINDS = {"signup": "enqueue", "view": "claim", "click": "heartbeat", "purchase": "complete", "error": "fail"}
DAY, LATE = 86400.0, 60


def lease_stream(spark: SparkSession, sf: str) -> DataFrame:
    """How the jobs stand when the stream of their events has ended: keyed state, leases of a day that timers end."""
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    owner = F.concat(F.lit("w"), (F.floor(F.col("event_id") / 5) % 2).cast("string"))
    log = _stamped(spark, sf).select(F.col("user_id").cast("string").alias("job"), "ts", F.col("ts").cast("double").alias("at"), kind.alias("kind"), owner.alias("owner"))
    changes = state.run(state.lease_changes(log, f"{LATE} seconds", DAY), "leases")
    return state.latest(changes).select("job", "status", "owner", "claims", "failures", "seq")


def limiter_stream(spark: SparkSession, sf: str) -> DataFrame:
    """``anchored_limits`` as a running stream."""
    log = _stamped(spark, sf).select("event_id", "ts", F.col("user_id").cast("string").alias("user"), F.floor(F.col("ts").cast("double")).cast("double").alias("at"))
    found = state.run(state.rate_windows(log, "user", DAY, 2), "limiter")
    return found.select("event_id", F.col("window_start").cast("bigint").alias("window_start"), "place", "allowed")


def _lease_sql() -> str:
    kind = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
    lapse = "status = 'running' AND lease < e.moment"
    own = "l.status = 'running' AND l.owner = l.whose"
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id::VARCHAR AS job, epoch(ts) AS moment, {kind} AS kind, 'w' || (event_id // 5) % 2 AS whose, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
      s AS (SELECT DISTINCT job, 0::BIGINT AS i, NULL::VARCHAR AS status, NULL::VARCHAR AS owner, NULL::DOUBLE AS lease, 0 AS claims, 0 AS failures, 0::BIGINT AS seq FROM e
      UNION ALL SELECT job, i, CASE WHEN enqueued THEN 'queued' WHEN claimed THEN 'running' WHEN completed THEN 'completed' WHEN failed AND failures + 1 >= 3 THEN 'failed' WHEN failed THEN 'queued' ELSE status END,
        CASE WHEN claimed THEN whose WHEN enqueued OR completed OR failed THEN NULL ELSE owner END, CASE WHEN claimed OR beaten THEN moment + {DAY}::DOUBLE WHEN enqueued OR completed OR failed THEN NULL ELSE lease END,
        CASE WHEN enqueued THEN 0 ELSE claims + claimed::INT END, CASE WHEN enqueued THEN 0 ELSE failures + failed::INT END, seq + (enqueued OR claimed OR beaten OR completed OR failed)::INT
      FROM (SELECT *, kind = 'enqueue' AND (status IS NULL OR status IN ('completed', 'failed')) AS enqueued, coalesce(kind = 'claim' AND status = 'queued', false) AS claimed, coalesce({own} AND kind = 'heartbeat', false) AS beaten,
        coalesce({own} AND kind = 'complete', false) AS completed, coalesce({own} AND kind = 'fail', false) AS failed
        FROM (SELECT s.job, e.i, e.moment, e.kind, e.whose, CASE WHEN {lapse} THEN CASE WHEN claims >= 25 THEN 'failed' ELSE 'queued' END ELSE status END AS status, CASE WHEN {lapse} THEN NULL ELSE owner END AS owner,
          CASE WHEN {lapse} THEN NULL ELSE lease END AS lease, claims, failures, seq + coalesce({lapse}, false)::INT AS seq FROM s JOIN e ON e.job = s.job AND e.i = s.i + 1) l)),
      z AS (SELECT *, coalesce(status = 'running' AND lease < (SELECT max(moment) - {LATE} FROM e), false) AS over FROM s WHERE seq > 0 QUALIFY row_number() OVER (PARTITION BY job ORDER BY i DESC) = 1)
      SELECT job, CASE WHEN over THEN CASE WHEN claims >= 25 THEN 'failed' ELSE 'queued' END ELSE status END AS status, CASE WHEN over THEN NULL ELSE owner END AS owner, claims, failures, seq + over::INT AS seq FROM z"""


LIMITER_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events), s AS (SELECT user_id, min(t) AS start FROM e GROUP BY 1
  UNION ALL SELECT s.user_id, n.t FROM s, LATERAL (SELECT min(t) AS t FROM e WHERE e.user_id = s.user_id AND e.t >= s.start + 86400) n WHERE n.t IS NOT NULL)
  SELECT event_id, start AS window_start, row_number() OVER (PARTITION BY e.user_id, start ORDER BY t, event_id) AS place, row_number() OVER (PARTITION BY e.user_id, start ORDER BY t, event_id) <= 2 AS allowed
  FROM e JOIN s ON s.user_id = e.user_id AND e.t >= s.start AND e.t < s.start + 86400"""

QUERIES = {
    "lease_stream": (lease_stream, _lease_sql()),
    "limiter_stream": (limiter_stream, LIMITER_SQL),
    "stream_hourly": (stream_hourly, "SELECT event_type, (floor(epoch(ts))::BIGINT // 3600) * 3600 AS start, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_sliding": (stream_sliding, """SELECT event_type, h * 3600 AS start, count(*) AS n FROM (SELECT event_type, unnest([floor(epoch(ts))::BIGINT // 3600, floor(epoch(ts))::BIGINT // 3600 - 1]) AS h FROM events) GROUP BY 1, 2"""),
    "stream_audit": (stream_audit, "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('purchase', 'error')"),
}
