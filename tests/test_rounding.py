"""Halves: queries and their DuckDB statements round them alike."""

import random

import duckdb
from pyspark.sql import functions as F

from tomelight.plans import curation, relational  # noqa: F401
from tomelight.plans.registry import ORACLE, QUERIES


def _both(spark, folder, name, rows):
    """The rows of a query and of its statement over events of (user_id, ts, event_type, value)."""
    events = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "event_id long, user_id long, ts string, event_type string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(5).write.parquet(f"{folder}/events.parquet")
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    found = db.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in df.columns]
    return sorted(tuple(r) for r in df.collect()), sorted(tuple(r[k] for k in order) for r in found.fetchall())


def test_expiry_on_half_days(spark, tmp_path):
    rows = [(1, f"2024-01-{day} 12:00:00", "view", v) for day in (29, 31) for v in (0.5, 1.5, 2.5, 3.5)]  # 0, 2, 2 and 4 days
    ours, theirs = _both(spark, tmp_path, "q_expiry", rows)
    assert ours == theirs == [("view", 4, 8)]


def test_period_sums_on_half_minutes(spark, tmp_path):
    draw, rows = random.Random(5), []
    for user in range(40):  # each user's seconds make 90 to the cent, which doubles miss in some orders
        cents = [draw.randrange(1, 900) for _ in range(9)]
        rows += [(user, "2024-01-30 12:00:00", "view", c / 100) for c in (*cents, 9000 - sum(cents))]
    ours, theirs = _both(spark, tmp_path, "q_period_sums", rows)
    assert ours == theirs == [(user, 2, 10, 10) for user in range(40)]
