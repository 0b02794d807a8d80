"""Event streams: windowed counts with late data, sessions and a token bucket as streaming DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """A directory of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _marked(events: DataFrame, at: str, late: str) -> DataFrame:
    """Streams need a watermark, and that a timestamp with a zone (the session's, UTC)."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events


def window_counts(events: DataFrame, key: str, at: str, width: str, late: str) -> DataFrame:
    """Events of each key and tumbling window; rows later than `late` behind the newest are left out. Batch and stream alike."""
    return _marked(events, at, late).groupBy(key, F.window(at, width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("slot"), "n")


def session_counts(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Events of each session of a key: a session ends after `gap` without an event."""
    return _marked(events, at, late).groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").cast("timestamp_ntz").alias("start"), F.col("s.end").cast("timestamp_ntz").alias("end"), "n")


def _admitted(times, capacity: float, per_second: float, tokens: float, last: float | None) -> tuple[list[bool], float, float | None]:
    """Which of some sorted times (seconds) find a token, and the bucket after them; last is None for a bucket never used."""
    out = []
    for t in times:
        tokens = capacity if last is None else min(capacity, tokens + max(0.0, t - last) * per_second)
        last = t if last is None else max(last, t)
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out, tokens, last


def _seconds(x: pd.Series) -> pd.Series:
    return x.astype("datetime64[us]").astype("int64") / 1e6


def token_bucket(events: DataFrame, key: str, at: str, capacity: float, per_second: float) -> DataFrame:
    """events (key, at, event_id) with `admitted`: each takes a token of its key's bucket, which refills over time.

    State is two numbers a key. Within a micro-batch a key's events are taken in order of time and id."""

    def admit(name, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values([at, "event_id"])  # a key's events of one micro-batch
        admitted, tokens, last = _admitted(_seconds(rows[at]), capacity, per_second, tokens, last)
        state.update((tokens, last))
        yield pd.DataFrame({key: rows[key], "event_id": rows["event_id"], "admitted": admitted})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(admit, f"{key} {kind}, event_id long, admitted boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def token_bucket_batch(events: DataFrame, key: str, at: str, capacity: float, per_second: float) -> DataFrame:
    """As token_bucket over a table: partitions of keys, sorted by time, are read in batches, and only the open bucket is held."""
    kind = events.schema[key].dataType.simpleString()

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, tokens, last = None, capacity, None
        for rows in batches:
            out = []
            for name, own in rows.groupby(key, sort=False):
                if open_key is None or name != open_key:
                    open_key, tokens, last = name, capacity, None
                admitted, tokens, last = _admitted(_seconds(own[at]), capacity, per_second, tokens, last)
                out.append(pd.DataFrame({key: own[key], "event_id": own["event_id"], "admitted": admitted}))
            if out:
                yield pd.concat(out)

    rows = events.where(F.col(key).isNotNull()).select(key, "event_id", at)
    return rows.repartition(key).sortWithinPartitions(key, at, "event_id").mapInPandas(admit, f"{key} {kind}, event_id long, admitted boolean")


def jsonl_sink(stream: DataFrame, folder: str, checkpoint: str):
    """Starts a query that appends a stream to a folder as lines of JSON, each row once; ends when what is there has been read."""
    return stream.writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
