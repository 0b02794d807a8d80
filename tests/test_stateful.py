"""Stateful streams: timers, restart from a checkpoint and replayed batches give what the batch forms and plain Python give."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tomelight.streaming import ledger, stateful as S
from tomelight.streaming.events import event_stream

START = datetime(2024, 1, 1)
CALL = "user_id long, event_id long, ts timestamp_ntz, failed boolean"


@pytest.fixture
def spark(spark):
    S.state_store(spark)
    return spark


def calls(n=400, users=6, seed=1):
    rng, at, rows = random.Random(seed), START, []
    for k in range(n):
        at += timedelta(seconds=rng.choice((1, 20, 60, 400)))
        rows.append((rng.randrange(users), k, at, rng.random() < 0.6))
    return rows


def files(spark, folder, rows, kind, parts):
    """Each part as one file, in order of name and time."""
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], kind).coalesce(1).write.mode("append").parquet(folder)


def ran(df, folder, name):
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c-{name}").outputMode("append").trigger(availableNow=True).start(f"{folder}/o-{name}")
    q.awaitTermination(240)
    return [tuple(r) for r in df.sparkSession.read.schema(df.schema).parquet(f"{folder}/o-{name}").collect()]


def plain_breaker(rows, threshold, cooldown):
    out, state = {}, {}
    for user, event, at, failed in rows:
        run, last = state.get(user, (0, None))
        if run >= threshold:
            if (at - last).total_seconds() < cooldown:
                out[event] = "refused"
                continue
            run = 0
        out[event] = "passed"
        state[user] = (run + 1, at) if failed else (0, None)
    return out, {u for u, (run, _) in state.items() if run >= threshold}


def test_breaker(spark, tmp_path):
    rows = calls()
    want, left_open = plain_breaker(rows, 3, 600)
    table = spark.createDataFrame(rows, CALL)
    assert {r.event_id: r.state for r in S.breaker_calls(table, "user_id", "ts", 3, 600).collect()} == want
    assert set(want.values()) == {"passed", "refused"}
    rows.append((99, 1000, rows[-1][2] + timedelta(hours=2), False))  # moves the watermark past all cool-downs
    files(spark, f"{tmp_path}/in", rows[:200], CALL, 3)
    stream = lambda: S.breaker_stream(event_stream(spark, f"{tmp_path}/in", table.schema, 1), "user_id", "ts", 3, 600, "1 minute")
    first = ran(stream(), tmp_path, "breaker")
    assert {e: s for _, e, s in first if e is not None} == {k: v for k, v in want.items() if k < 200}
    files(spark, f"{tmp_path}/in", rows[200:], CALL, 3)
    got = ran(stream(), tmp_path, "breaker")  # goes on from its checkpoint, with the state of open breakers
    assert {e: s for _, e, s in got if e not in (None, 1000)} == want and len([e for _, e, _ in got if e is not None]) == 401
    closed = [u for u, e, _ in got if e is None]
    assert left_open <= set(closed) and 99 not in closed


def test_adaptive_delay(spark, tmp_path):
    rows, want, now = calls(seed=2), {}, {}
    for user, event, _, failed in rows:
        d = now.get(user, 200.0)
        now[user] = want[event] = min(5000.0, d * 2) if failed else max(50.0, d * 0.9)
    table = spark.createDataFrame(rows, CALL)
    assert {r.event_id: r.delay for r in S.adaptive_delays(table.repartition(5), "user_id", "ts", 200.0).collect()} == want
    files(spark, f"{tmp_path}/in", rows, CALL, 4)
    stream = S.adaptive_delay_stream(event_stream(spark, f"{tmp_path}/in", table.schema, 1), "user_id", "ts", 200.0)
    assert {e: d for _, e, d in ran(stream, tmp_path, "delay")} == want


def test_leases(spark, tmp_path):
    kind = "job long, event_id long, ts timestamp_ntz, attempts int, done boolean"
    rng = random.Random(3)
    rows = [(user, k, at, rng.randrange(1, 10), rng.random() < 0.3) for user, k, at, _ in calls(300, 9, 3)]
    rows.append((99, 1000, rows[-1][2] + timedelta(hours=3), 1, True))
    table = spark.createDataFrame(rows, kind)
    want = {}
    for n, (job, event, at, attempts, done) in enumerate(rows):
        after = next((t for j, _, t, *_ in rows[n + 1 :] if j == job), rows[-1][2])
        end = at + timedelta(seconds=700)
        if not done and after >= end:
            fails = attempts >= 5
            want[event] = (job, "failed" if fails else "retrying", end, None if fails else end + timedelta(seconds=30 * 2 ** min(attempts - 1, 6)))
    found = S.lapsed_leases(table, "job", "ts", 700, 5, 30).collect()
    assert {r.event_id: (r.job, r.status, r.lapsed, r.due) for r in found} == want and len({w[1] for w in want.values()}) == 2
    stream = lambda: S.lease_stream(event_stream(spark, f"{tmp_path}/in", table.schema, 1), "job", "ts", 700, 5, 30, "1 minute")
    files(spark, f"{tmp_path}/in", rows[:150], kind, 3)
    ran(stream(), tmp_path, "lease")
    files(spark, f"{tmp_path}/in", rows[150:], kind, 3)
    got = ran(stream(), tmp_path, "lease")
    assert len(got) == len(want) and {e: (j, s, a, d) for j, e, s, a, d in got} == want


def test_sums_survive_a_replay(spark, tmp_path):
    rows = calls(300, 4, 4)
    table = spark.createDataFrame(rows, CALL)
    add = ledger.add_batch(f"{tmp_path}/days", {"user_id": F.col("user_id"), "day": F.to_date("ts")}, {"n": F.lit(1), "failures": F.col("failed").cast("int")})
    files(spark, f"{tmp_path}/in", rows, CALL, 5)
    read = lambda: sorted(map(tuple, ledger.totals(spark, f"{tmp_path}/days", ["user_id", "day"], ["n", "failures"]).collect()))
    ledger.into(event_stream(spark, f"{tmp_path}/in", table.schema, 1), add, f"{tmp_path}/c").awaitTermination(240)
    want = sorted(map(tuple, table.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*"), F.sum(F.col("failed").cast("int"))).collect()))
    assert read() == want
    add(spark.createDataFrame(rows[:60], CALL), 0)  # the first batch again
    assert read() == want
    ledger.into(event_stream(spark, f"{tmp_path}/in", table.schema, 1), add, f"{tmp_path}/lost").awaitTermination(240)  # all of them, as the checkpoint was lost
    assert read() == want
    add(spark.createDataFrame(rows[:10], CALL), 5)
    assert sum(r[2] for r in read()) == 310


def test_messages_are_delivered_once(spark, tmp_path):
    kind, folder = "id long, body string", f"{tmp_path}/marks"
    frame = lambda ids: spark.createDataFrame([(k, f"m{k}") for k in ids], kind)
    send = ledger.deliver_batch(folder, "id")
    everything = frame(range(12))
    assert ledger.undelivered(everything, folder, "id").count() == 12
    sent = lambda: sorted((r.batch_id, r.id) for r in spark.read.parquet(folder).collect())
    send(frame([0, 1, 1, 2]), 0)
    send(frame([2, 3, 4]), 1)  # 2 came before
    want = [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4)]
    assert sent() == want
    send(frame([0, 1, 1, 2]), 0)
    send(frame([2, 3, 4]), 1)  # both again
    assert sent() == want
    send(frame([4, 9]), 2)
    assert sent() == [*want, (2, 9)]
    assert sorted(r.id for r in ledger.undelivered(everything, folder, "id").collect()) == [5, 6, 7, 8, 10, 11]
