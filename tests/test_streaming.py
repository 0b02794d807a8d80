"""Streams over files give what the batch form gives."""

from pyspark.sql import functions as F

from tomelight.functions import columns as C
from tomelight.functions.text import sentences, title_key
from tomelight.operators import labelling as L
from tomelight.streaming import events as E

SF = "/root/testdata/sf0.001"


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_window_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/e")
    stream = E.event_stream(spark, f"{tmp_path}/e", events.schema)
    got = drained(E.window_counts(stream, "event_type", "ts", "1 hour", "60 days"), "windows", "complete")
    assert sorted(map(tuple, got)) == sorted(map(tuple, E.window_counts(events, "event_type", "ts", "1 hour", "1 hour").collect()))


def test_token_bucket(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:0{k // 4}", k) for k in range(12)]
    events = spark.createDataFrame(rows, "user_id long, ts string, event_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(f"{tmp_path}/e")
    got = drained(E.token_bucket(E.event_stream(spark, f"{tmp_path}/e", events.schema), "user_id", "ts", 2.0, 1.0), "bucket", "append")
    assert {r.event_id for r in got if r.admitted} == {0, 1, 4, 8}


def test_functions(spark):
    row = spark.range(1).select(
        C.dice(F.lit("naruto"), F.lit("naruto")).alias("a"), C.dice(F.lit("a"), F.lit("a")).alias("b"), C.similarity(F.lit(""), F.lit("")).alias("c"), title_key(F.lit("Ü-bér 9")).alias("d"),
        sentences(F.lit("Dr. X went. Then J. K. left... so? Yes")).alias("e"), C.comparable_url(F.lit("HTTP://a.b/c/?q#f")).alias("f"), C.slug(F.lit(" Class Pass ")).alias("g"),
        L.bio_entities(F.array(*map(F.lit, ["I-A", "B-A", "I-A", "I-B", "O", "I-B"]))).alias("h"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.f, row.g) == (1.0, 0.0, 1.0, "uber9", "https://a.b/c", "class-pass")
    assert row.e == ["Dr. X went.", "Then J. K. left... so?", "Yes"]
    assert [tuple(e) for e in row.h] == [("A", 1, 2), ("B", 3, 3)]
    path = L.viterbi(spark.createDataFrame([([[1.0, 0.0], [0.0, 0.9], [1.0, 0.0]],), (None,)], "x array<array<double>>"), "x", [[0.5, -1.0], [-1.0, 0.5]]).collect()
    assert [r.path for r in path] == [[0, 0, 0], []]
