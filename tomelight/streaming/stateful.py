"""Keyed state with event-time timers: circuit breaker, leases that run out, and adaptive delays; each with its batch form.

Streams need the RocksDB state store (state_store) and a watermark on the time column; what a row gives depends on its
own time and the rows of its key before it, never on when a timer happens to fire. Rows of a key have to come in order of
time from one micro-batch to the next; within one they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Keep state where value states and timers are supported."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _micros(x: pd.Series) -> list[int]:
    return x.astype("datetime64[us]").astype("int64").tolist()


def _times(x: list) -> pd.Series:
    return pd.Series(pd.to_datetime(pd.Series(x, dtype="Int64").astype("float64").astype("Int64"), unit="us"), dtype="datetime64[us]")


class BreakerState:
    """Failures in a row, the time of the last one, and whether calls are refused; times in microseconds."""

    def __init__(self, threshold: int, cooldown: int, failures: int = 0, last: int = 0):
        self.threshold, self.cooldown, self.failures, self.last = threshold, cooldown, failures, last

    @property
    def open(self) -> bool:
        return self.failures >= self.threshold

    def call(self, at: int, failed: bool) -> bool:
        """Whether a call is refused. Refused calls do not count; after the cool-down the breaker starts anew."""
        if self.open and at - self.last < self.cooldown:
            return True
        if self.open or not failed:
            self.failures = 0
        if failed:
            self.failures, self.last = self.failures + 1, at
        return False


class _Breaker(StatefulProcessor):
    def __init__(self, key: str, at: str, threshold: int, cooldown: int):
        self.key, self.at, self.threshold, self.cooldown = key, at, threshold, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("breaker", "failures int, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = BreakerState(self.threshold, self.cooldown, *(self.state.get() if self.state.exists() else ()))
        own = pd.concat(list(rows)).sort_values([self.at, "event_id"])  # a key's calls of one micro-batch
        refused = [found.call(t, f) for t, f in zip(_micros(own[self.at]), own["failed"].tolist(), strict=True)]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if found.failures:
            self.state.update((found.failures, found.last))
            if found.open:
                self.handle.registerTimer((found.last + self.cooldown) // 1000)
        else:
            self.state.clear()
        yield pd.DataFrame({self.key: [key[0]] * len(own), "event_id": own["event_id"].tolist(), "state": ["refused" if r else "passed" for r in refused]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame({self.key: [key[0]], "event_id": pd.Series([None], dtype="Int64"), "state": ["closed"]})

    def close(self) -> None:
        pass


def breaker_stream(calls: DataFrame, key: str, at: str, threshold: int, cooldown_s: int, late: str) -> DataFrame:
    """key, event_id, state of calls (key, at, event_id, failed): passed or refused; a row without event_id, closed, when the cool-down ends in a key without further calls."""
    kind = calls.schema[key].dataType.simpleString()
    calls = calls.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return calls.groupBy(key).transformWithStateInPandas(_Breaker(key, at, threshold, cooldown_s * 1_000_000), f"{key} {kind}, event_id long, state string", "Append", "EventTime")


def _scanned(rows: DataFrame, key: str, at: str, value: str, start, step, name: str, kind: str) -> DataFrame:
    """A table's rows by key and time, each with what step(state, time, value) gives; only the state of one key is held."""
    key_kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            out = []
            for k, t, v in zip(batch[key].tolist(), _micros(batch[at]), batch[value].tolist(), strict=True):
                if state is None or k != last:
                    last, state = k, start()
                out.append(step(state, t, v))
            yield pd.DataFrame({key: batch[key], "event_id": batch["event_id"], name: out})

    dealt = rows.where(F.col(key).isNotNull()).select(key, "event_id", at, value).repartition(key).sortWithinPartitions(key, at, "event_id")
    return dealt.mapInPandas(run, f"{key} {key_kind}, event_id long, {name} {kind}")


def breaker_calls(calls: DataFrame, key: str, at: str, threshold: int, cooldown_s: int) -> DataFrame:
    """As breaker_stream over a table, without rows of closing."""
    step = lambda s, t, failed: "refused" if s.call(t, failed) else "passed"
    return _scanned(calls, key, at, "failed", lambda: BreakerState(threshold, cooldown_s * 1_000_000), step, "state", "string")


class Delay:
    """A delay that shrinks by success and grows by failure, within bounds (milliseconds)."""

    def __init__(self, now: float, least: float = 50.0, most: float = 5000.0, less: float = 0.9, more: float = 2.0):
        self.now, self.least, self.most, self.less, self.more = now, least, most, less, more

    def after(self, failed: bool) -> float:
        self.now = min(self.most, self.now * self.more) if failed else max(self.least, self.now * self.less)
        return self.now


class _Delays(StatefulProcessor):
    def __init__(self, key: str, at: str, start: float):
        self.key, self.at, self.start = key, at, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("delay", "now double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        delay = Delay(self.state.get()[0] if self.state.exists() else self.start)
        own = pd.concat(list(rows)).sort_values([self.at, "event_id"])
        out = [delay.after(f) for f in own["failed"].tolist()]
        self.state.update((delay.now,))
        yield pd.DataFrame({self.key: [key[0]] * len(own), "event_id": own["event_id"].tolist(), "delay": out})

    def close(self) -> None:
        pass


def adaptive_delay_stream(calls: DataFrame, key: str, at: str, start: float) -> DataFrame:
    """key, event_id and the delay in force after each call."""
    kind = calls.schema[key].dataType.simpleString()
    return calls.groupBy(key).transformWithStateInPandas(_Delays(key, at, start), f"{key} {kind}, event_id long, delay double", "Append", "None")


def adaptive_delays(calls: DataFrame, key: str, at: str, start: float) -> DataFrame:
    """As adaptive_delay_stream over a table."""
    return _scanned(calls, key, at, "failed", lambda: Delay(start), lambda s, t, failed: s.after(failed), "delay", "double")


LAPSE = "event_id long, status string, lapsed timestamp, due timestamp"
#: Doublings of the retry delay at most.
DOUBLINGS = 6


class _Leases(StatefulProcessor):
    """Per job the last sign of life; a timer stands where its lease, and the time of grace, run out."""

    def __init__(self, key: str, at: str, grace: int, most: int, delay: int):
        self.key, self.at, self.grace, self.most, self.delay = key, at, grace, most, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("lease", "event_id long, attempts int, ends long")

    def _lapsed(self, key, found: list[tuple[int, int, int]]) -> pd.DataFrame:
        due = [end + self.delay * 2 ** min(a - 1, DOUBLINGS) if a < self.most else None for _, a, end in found]
        status = ["failed" if a >= self.most else "retrying" for _, a, _ in found]
        return pd.DataFrame({self.key: [key[0]] * len(found), "event_id": [i for i, _, _ in found], "status": status, "lapsed": _times([e for _, _, e in found]), "due": _times(due)})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        out = []
        own = pd.concat(list(rows)).sort_values([self.at, "event_id"])
        for event, at, done, attempts in zip(own["event_id"].tolist(), _micros(own[self.at]), own["done"].tolist(), own["attempts"].tolist(), strict=True):
            if held and at >= held[2]:
                out.append(tuple(held))
            held = None if done else (event, attempts, at + self.grace)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.state.update(held)
            self.handle.registerTimer(-(-held[2] // 1000))
        else:
            self.state.clear()
        if out:
            yield self._lapsed(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.state.exists():
            held = tuple(self.state.get())
            self.state.clear()
            yield self._lapsed(key, [held])

    def close(self) -> None:
        pass


def lease_stream(signs: DataFrame, key: str, at: str, grace_s: int, most: int, delay_s: int, late: str) -> DataFrame:
    """Leases that ran out: key, event_id of the last sign of life, status, when the lease ended and when to try again.

    signs: key, at, event_id, attempts, done. Each sign that is not the end of its job holds the lease for grace_s
    seconds more. With `most` attempts used up a job fails; else it is tried again after delay_s seconds, doubled for
    each attempt before, DOUBLINGS times at most.
    """
    kind = signs.schema[key].dataType.simpleString()
    signs = signs.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return signs.groupBy(key).transformWithStateInPandas(_Leases(key, at, grace_s * 1_000_000, most, delay_s * 1_000_000), f"{key} {kind}, {LAPSE}", "Append", "EventTime")


def lapsed_leases(signs: DataFrame, key: str, at: str, grace_s: int, most: int, delay_s: int) -> DataFrame:
    """As lease_stream over a table: leases that ran out before the next sign of their job or, for the last one, before the newest sign of all."""
    end = F.col(at) + F.make_dt_interval(secs=F.lit(grace_s))
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at, "event_id"))
    newest = signs.agg(F.max(at).alias("newest"))  # one row
    rows = signs.where(F.col(key).isNotNull()).withColumn("following", following).crossJoin(F.broadcast(newest)).withColumn("lapsed", end)
    rows = rows.where(~F.col("done") & (F.coalesce("following", "newest") >= F.col("lapsed")))
    wait = F.make_dt_interval(secs=F.lit(delay_s) * F.pow(F.lit(2), F.least(F.col("attempts") - 1, F.lit(DOUBLINGS))))
    fails = F.col("attempts") >= most
    return rows.select(key, "event_id", F.when(fails, "failed").otherwise("retrying").alias("status"), "lapsed", F.when(~fails, F.col("lapsed") + wait).alias("due"))
