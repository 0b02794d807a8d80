"""Streaks, sessions, sliding windows and trends over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def streaks(days: DataFrame, key: str, day: str) -> DataFrame:
    """Runs of consecutive days for each key: key, first_day, last_day, length."""
    distinct = days.select(key, F.col(day).cast("date").alias("day")).distinct()
    order = Window.partitionBy(key).orderBy("day")
    island = F.date_sub("day", F.row_number().over(order))
    runs = distinct.withColumn("island", island).groupBy(key, "island")
    return runs.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("length")).drop("island")


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """events with the number of their session: a new one begins after a gap of more than gap_seconds."""
    order = Window.partitionBy(key).orderBy(at, "event_id")
    seconds = F.unix_timestamp(F.col(at).cast("timestamp"))
    new = (seconds - F.lag(seconds).over(order) > gap_seconds).cast("int")
    return events.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def paired_sessions(events: DataFrame, key: str, at: str, start: str, stop: str, cap_seconds: int, now: str | None = None) -> DataFrame:
    """Sessions from each start to the next start or stop of the key, capped: key, at, seconds.

    A start without either lasts until `now`, a column of seconds since 1970, or is left out."""
    order = Window.partitionBy(key).orderBy(at, "event_id")
    marks = events.where(F.col("event_type").isin(start, stop))
    seconds = F.unix_timestamp(F.col(at).cast("timestamp"))
    until = F.lead(seconds).over(order)
    length = (F.coalesce(until, F.col(now)) if now else until) - seconds
    marks = marks.withColumn("seconds", F.when(length.isNotNull(), F.least(length, F.lit(cap_seconds))))
    return marks.where((F.col("event_type") == start) & F.col("seconds").isNotNull()).select(key, at, F.col("seconds").cast("long").alias("seconds"))


def trailing_counts(events: DataFrame, key: str, at: str, seconds: dict[str, int]) -> DataFrame:
    """events with the number of the key's events in each trailing window, the event itself included."""
    clock = F.unix_micros(F.col(at).cast("timestamp"))
    for name, width in seconds.items():
        events = events.withColumn(name, F.count("*").over(Window.partitionBy(key).orderBy(clock).rangeBetween(-width * 1_000_000, 0)))
    return events


def breaker(events: DataFrame, key: str, at: str, failed: Column, threshold: int, cooldown_seconds: int) -> DataFrame:
    """events with `refused`: the key's breaker is open for them, `threshold` failures or more in a row before them, the
    last within the cool-down; a success clears it. Calls count as they came, refused or not."""
    order = Window.partitionBy(key).orderBy(at, "event_id")
    rows = events.withColumn("__n", F.row_number().over(order)).withColumn("__failed", failed)
    seen = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__run", F.col("__n") - F.coalesce(F.max(F.when(~F.col("__failed"), F.col("__n"))).over(seen), F.lit(0)))
    clock = F.unix_micros(F.col(at).cast("timestamp"))
    opened = F.max(F.when(F.col("__run") >= threshold, clock)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    refused = (F.lag("__run").over(order) >= threshold) & (clock - opened < cooldown_seconds * 1_000_000)
    return rows.withColumn("refused", F.coalesce(refused, F.lit(False))).drop("__n", "__failed", "__run")
