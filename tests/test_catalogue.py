"""Ranges, votes and cascades on small fixtures with nulls, ties, repeated rows and empty tables."""

import random

import pytest

from tomelight.operators import consensus, ranges, relational as R
from tomelight.operators.consensus import ANCHORS, WEIGHTS

CLAIM = "entity long, provider string, value double"


def votes(rows, tolerance):
    """The numeric vote of one entity, one claim (provider, value) at a time."""
    clusters = []
    for p, v in sorted(rows, key=lambda x: (-WEIGHTS[x[0]], x)):
        for c in clusters:
            if abs(c[0] - v) / max(abs(c[0]), abs(v), 1) <= tolerance:
                c[1] += WEIGHTS[p]
                c[2].append(p)
                break
        else:
            clusters.append([v, WEIGHTS[p], [p]])
    first, weight, names = min(clusters, key=lambda c: (-round(c[1], 9), -len(c[2]), c[0]))
    k = len({"anchor" if p in ANCHORS else p for p in names})
    return first, round(weight, 6), len(names), round(weight / sum(c[1] for c in clusters) * {1: 0.6, 2: 0.85}.get(k, 1.0), 6)


def test_numeric_vote(spark):
    rng = random.Random(3)
    rows = [(e, rng.choice(list(WEIGHTS)), float(rng.choice([0, 1, 40, 41, 42, 43, 44, 100, 103, -40]))) for e in range(80) for _ in range(rng.randint(1, 14))]
    rows += rows[:9]
    df = spark.createDataFrame([*rows, (999, "mal", None), (1, "unknown", 5.0), (None, None, None)], CLAIM)
    got = {r[0]: tuple(r[1:]) for r in consensus.numeric_vote(df, 0.05).collect()}
    assert got == {e: votes([(p, v) for x, p, v in rows if x == e], 0.05) for e in range(80)}
    assert not consensus.numeric_vote(df.where("false"), 0.05).collect()


def test_votes_of_unknown_providers_do_not_count(spark):
    rows = [(1, "mal", 5.0), (1, "nobody", 9.0), (1, "nobody", 9.0), (2, "nobody", 1.0), (3, "mal", None)]
    assert [tuple(r) for r in consensus.categorical_vote(spark.createDataFrame(rows, CLAIM)).collect()] == [(1, 5.0, 1.0, 0.6)]


@pytest.mark.parametrize("counts, expected", [
    ({"mangadex": 17}, (17, "low")), ({"anilist": 10, "mal": 11}, (11, "high")), ({"anilist": 10, "kitsu": 10, "fandom": 50}, (10, "medium")),
    ({"anilist": 10, "kitsu": 50}, (10, "low")), ({"anilist": 10, "mal": 10, "kitsu": 50, "fandom": 50}, (50, "low")),
])
def test_count_consensus(spark, counts, expected):
    df = spark.createDataFrame([(1, p, float(v)) for p, v in counts.items()] + [(1, "wikipedia", None)], CLAIM)
    assert [(r.value, r.level) for r in consensus.count_consensus(df, 1).collect()] == [expected]


def test_overlap_join(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 2, None]), k, a, a + rng.randint(-1, 30)) for k, a in enumerate(rng.randint(-50, 120) for _ in range(90))] + [(1, 90, None, 4)]
    df = spark.createDataFrame(rows, "key long, id long, a long, b long")
    got = {(r.l.id, r.r.id, r.since, r.until) for r in ranges.overlap_join(df, df, "key", "a", "b", 7, "l.id < r.id").collect()}
    ok = [r for r in rows if r[0] is not None and r[2] is not None]
    assert got == {(x[1], y[1], max(x[2], y[2]), min(x[3], y[3])) for x in ok for y in ok if x[0] == y[0] and x[1] < y[1] and x[2] <= x[3] and y[2] <= y[3] and max(x[2], y[2]) <= min(x[3], y[3])}


def test_trim_overlaps(spark):
    rng = random.Random(6)
    rows = [(k % 3, k, a, a + rng.randint(0, 40)) for k, a in enumerate(rng.randint(0, 300) for _ in range(60))]
    got = {tuple(r) for r in ranges.trim_overlaps(spark.createDataFrame(rows, "key long, id long, a long, b long"), "key", "a", "b", "id").collect()}
    want, last = set(), {}
    for key, k, a, b in sorted(rows, key=lambda r: (r[0], r[2], r[1])):  # each step sees the repair before
        a = max(a, last.get(key, a - 1) + 1)
        if a <= b:
            want.add((key, k, a, b))
            last[key] = b
    assert got == want


def test_match_cascade(spark):
    known = spark.createDataFrame([(1, "x", 10), (1, "x", 9), (2, "y", 20), (None, "z", 30)], "a long, b string, id long")
    wanted = spark.createDataFrame([(0, 1, "x"), (1, 9, "y"), (2, None, "z"), (3, 9, None), (3, 9, None)], "row long, a long, b string")
    got = sorted((r["row"], r["id"], r["clause"]) for r in R.match_cascade(wanted, known, [["a", "b"], ["b"]], "id", "clause").collect())
    assert got[:3] == [(0, 9, 0), (1, 20, 1), (2, 30, 1)] and got[3:] == [(3, None, None)] * 2
