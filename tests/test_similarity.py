"""Similarity joins against all pairs, and how few pairs they look at."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tomelight.functions import columns as C
from tomelight.operators import matching as M, similarity as S

SF = "/root/testdata/sf0.01"


def frame(spark, texts, name):
    return spark.createDataFrame([(t,) for t in texts], f"{name} string").repartition(3)


def every_pair(spark, a, b, score, least):
    rows = frame(spark, set(a), "a").crossJoin(frame(spark, set(b), "b")).withColumn("s", score(F.col("a"), F.col("b"))).where(F.col("s") >= least - 1e-9)
    return {(r.a, r.b): round(r.s, 9) for r in rows.collect()}


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
    out = ["", "a", "A ", " ab", "aaaaaaaa", "aaaaaaa", "日本語", "日本", "été"]
    while len(out) < n:
        t = list(rng.choice(out) if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randrange(1, 4))))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = [rng.choice("abc ")] * rng.randrange(2)
        out.append("".join(t))
    return out


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_against_all_pairs(spark, least):
    a, b = texts(1, 150), texts(2, 120)
    got = {(r.a, r.b): round(r.dice, 9) for r in S.dice_join(frame(spark, a, "a"), frame(spark, b, "b"), "a", "b", least).collect()}
    want = every_pair(spark, a, b, C.dice, least)
    assert got == want and want
    found = S.edit_join(frame(spark, a, "a"), frame(spark, b, "b"), "a", "b", least).collect()
    got = {(r.a, r.b): round(r.score, 9) for r in found}
    assert got == every_pair(spark, a, b, C.similarity, least) and len(found) == len(got)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 2**30), st.sampled_from([0.6, 0.7, 0.9]))
def test_edit_join_by_chance(spark, seed, least):
    a = texts(seed, 60)
    got = {(r.a, r.b): round(r.score, 9) for r in S.edit_join(frame(spark, a, "a"), frame(spark, a, "b"), "a", "b", least).collect()}
    assert got == every_pair(spark, a, a, C.similarity, least)


def plain_dice(a, b):
    x, y = (Counter(t[k : k + 2] for k in range(len(t) - 1)) for t in (a, b))
    return 2 * (x & y).total() / (x.total() + y.total()) if x and y else 0.0


def test_dice_of_multisets(spark):
    a = [*texts(3, 60), "\U0001f600\U0001f600\U0001f600", "\U0001f600\U0001f600", "ab" * 150, "ab" * 100 + "ba" * 50]
    rows = frame(spark, set(a), "a").crossJoin(frame(spark, set(a), "b")).select("a", "b", C.dice(F.col("a"), F.col("b")).alias("s")).collect()
    assert len(rows) == len(set(a)) ** 2 and all(abs(r.s - plain_dice(r.a, r.b)) < 1e-12 for r in rows)
    null = spark.createDataFrame([(None, "abc")], "a string, b string").select(C.dice(F.col("a"), F.col("b"))).first()[0]
    assert null is None or null == 0


def match_rows(spark):
    a, b = sorted(set(texts(4, 70))), sorted(set(texts(5, 90)))
    asked = [(t, k % 9 if k % 4 else None, float(k % 6), 1990 + k % 4 if k % 5 else None) for k, t in enumerate(a)]
    names = [(f"n{k % 60}", t + ("z" if k % 3 == 0 else ""), k % 60 % 9, float(k % 60 % 7), 1990 + k % 60 % 6) for k, t in enumerate(b)]
    one = spark.createDataFrame(asked, "asked string, ref long, chapters double, year long")
    return asked, names, one, spark.createDataFrame(names, "id string, name string, ref long, chapters double, year long")


def plain_score(a, b):
    if not a[0] or not b[1]:
        return 0.0
    x, y = len(a[0]), len(b[1])
    close = 0.7 + 0.3 * min(a[2], b[3]) / max(a[2], b[3]) if a[2] and b[3] else 1.0
    years = 1.0 if a[3] is None else 1.15 if a[3] == b[4] else 1.0 if abs(a[3] - b[4]) <= 2 else 0.8
    return round(plain_dice(a[0], b[1]) * min(x, y) / max(x, y) * close * years, 6)


def test_referenced_match_against_a_plain_one(spark):
    asked, names, one, two = match_rows(spark)
    want, ways = {}, Counter()
    for a in asked:
        found = []
        for b in names:
            fits = any(("z" in a[0]) == ("z" in c[1]) for c in names if c[0] == b[0])
            referred = a[1] is not None and a[1] == b[2]
            how = "edition" if referred and fits else "reference" if referred else "title" if fits else None
            if how and plain_score(a, b) >= 0.4:
                found.append((how, -plain_score(a, b), abs(len(a[0]) - len(b[1])), b[0]))
        if found:
            how, score, _, id_ = min(found)
            want[a[0]] = (id_, -score, how)
            ways[how] += 1
    got = M.referenced_match(one, two, lambda a, b: F.contains(a, F.lit("z")) != F.contains(b, F.lit("z"))).collect()
    assert {r.asked: (r.id, r.score, r.how) for r in got} == want and len(got) == len(want) and len(ways) == 3
    assert not M.referenced_match(one.where("false"), two, lambda a, b: F.lit(False)).collect()


def test_few_pairs_are_compared(spark):
    names = spark.read.parquet(f"{SF}/documents.parquet").select(F.substring("text", 1, 50).alias("name")).distinct()
    shared = M.dice_pairs(names, names.withColumnRenamed("name", "other"), "name", "other").count()
    edit = S.edit_candidates(names, names, 0.8).count()
    dice = S.dice_candidates(names, names.withColumnRenamed("name", "other"), "name", "other", 0.8).count()
    print("PAIRS", shared, edit, dice)
    assert edit < 0.1 * shared and dice < 0.35 * shared


def test_bags_are_not_made_in_filters(spark):
    """Spark puts a filter of the exploded array below distinct, where every row would make its bag; the outer form has none."""
    df = spark.range(10).selectExpr("concat('name ', id) AS name", "concat('name ', id % 3) AS other")
    pairs = S.dice_join(df.select("name"), df.select("other"), "name", "other", 0.9)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter")]
    assert filters and not any("size(" in f and "transform" in f and "array_intersect" not in f for f in filters)
    short = spark.createDataFrame([("a",), ("",), (None,), ("ab",)], "name string")
    assert [tuple(r) for r in S.dice_join(short, short.withColumnRenamed("name", "other"), "name", "other", 0.5).collect()] == [("ab", "ab", 1.0)]
