"""Engine surface, not in the reference: generic relational shapes that Spark gives, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.sources.tables import table


def price_summary(spark: SparkSession, sf: str) -> DataFrame:
    quantity = F.sum(F.col("l_quantity").cast("long"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(quantity.alias("quantity"), F.count("*").alias("n"))


def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def part_cube(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").cube("p_brand", "p_size").agg(F.count("*").alias("n"))


def shared_nations(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    return a.intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")))


def orders_before(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("following"))


def last_signup_asof(spark: SparkSession, sf: str) -> DataFrame:
    """As-of join of each purchase with its user's latest signup before it: one window instead of a range join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = table(spark, sf, "events").withColumn("signup", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w))
    return seen.where("event_type = 'purchase'").select("event_id", "signup")


def hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows of an hour."""
    return table(spark, sf, "events").groupBy("event_type", F.floor(F.unix_timestamp("ts") / 3600).alias("hour")).agg(F.count("*").alias("n"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user, ended by a day without events."""
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    at = table(spark, sf, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("s"))
    new = at.withColumn("new", (F.coalesce(F.col("s") - F.lag("s").over(w), F.lit(10**9)) > 86400).cast("long"))
    return new.groupBy("user_id").agg(F.sum("new").alias("sessions"))


QUERIES = {
    "price_summary": (price_summary, "SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "status_rollup": (status_rollup, "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "part_cube": (part_cube, "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size)"),
    "shared_nations": (shared_nations, "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "orders_before": (orders_before, "SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS following FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    "last_signup_asof": (last_signup_asof, """SELECT event_id, signup FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup FROM events) WHERE event_type = 'purchase'"""),
    "hourly_events": (hourly_events, "SELECT event_type, floor(epoch(ts))::BIGINT // 3600 AS hour, count(*) AS n FROM events GROUP BY 1, 2"),
    "sessions": (sessions, """SELECT user_id, sum(new)::BIGINT AS sessions FROM (SELECT user_id, CASE WHEN coalesce(s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id), 1000000000) > 86400 THEN 1 ELSE 0 END AS new
      FROM (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s FROM events)) GROUP BY 1"""),
}
