"""Batch forms of the stateful streams, and delivery marks, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tomelight.streaming import stateful

from .registry import Tables, query


@query("""WITH x AS (SELECT user_id, event_id, event_type, ts, event_id % 6 + 1 AS attempts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following, max(ts) OVER () AS newest FROM events)
SELECT user_id, event_id, CASE WHEN attempts >= 5 THEN 'failed' ELSE 'retrying' END AS status, ts + INTERVAL 6 HOUR AS lapsed, CASE WHEN attempts < 5 THEN ts + INTERVAL 6 HOUR + to_seconds(cast(30 * pow(2, least(attempts - 1, 6)) AS BIGINT)) END AS due
FROM x WHERE event_type <> 'purchase' AND coalesce(following, newest) >= ts + INTERVAL 6 HOUR""")
def q_lapsed_leases(t: Tables) -> DataFrame:
    """Leases of six hours that no later sign of life of their job renewed, and what becomes of the job."""
    signs = t.events.select("user_id", "event_id", "ts", (F.col("event_id") % 6 + 1).cast("int").alias("attempts"), (F.col("event_type") == "purchase").alias("done"))
    return stateful.lapsed_leases(signs, "user_id", "ts", 6 * 3600, 5, 30)


@query("""WITH x AS (SELECT event_id, list(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f FROM events)
SELECT event_id, round(list_reduce(list_prepend(200.0::DOUBLE, f), lambda d, x: CASE WHEN x = 1 THEN least(5000.0, d * 2) ELSE greatest(50.0, d * 0.9) END), 6) AS delay FROM x""")
def q_adaptive_delay(t: Tables) -> DataFrame:
    """The delay in force after each call: a tenth less by success, twice as long by failure."""
    calls = t.events.select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return stateful.adaptive_delays(calls, "user_id", "ts", 200.0).select("event_id", F.round("delay", 6).alias("delay"))


@query("""WITH marks AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A') SELECT o_custkey AS channel, count(*) AS sent, count(*) FILTER (l_orderkey IS NULL) AS waiting, min(o_orderkey) FILTER (l_orderkey IS NULL) AS oldest FROM orders LEFT JOIN marks ON o_orderkey = l_orderkey GROUP BY 1""")
def q_delivery_marks(t: Tables) -> DataFrame:
    """Messages of each channel, and those without a mark in the table of marks, where a message may be marked many times."""
    marks = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("marked", F.lit(True))
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("channel")).join(marks, "o_orderkey", "left")
    waiting = F.col("marked").isNull()
    return rows.groupBy("channel").agg(F.count("*").alias("sent"), F.count_if(waiting).alias("waiting"), F.min(F.when(waiting, F.col("o_orderkey"))).alias("oldest"))
