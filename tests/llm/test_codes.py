"""Vector codes against Python's whole numbers, DuckDB, and rows that break things."""

import hashlib
import math

import duckdb
import numpy as np
from hypothesis import given, settings, strategies as st

from tomelight.llm import vector_codes as vc
from tomelight.llm.queries import codes_sql

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, label int"


def plain(rows, rounds=6, entries=16):
    """rows: (id, vector, label) -> {id: (code, error, label error, digest)}, all in Python's whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    d = len(kept[0][1]) // 8
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(8)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: [min((apart(cut(v, p), c), k) for k, c in enumerate(books[p])) for p in range(8)]
    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            for p, (_, k) in enumerate(assign(v)):
                groups.setdefault((p, k), []).append(cut(v, p))
        for (p, k), own in groups.items():
            books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), label) for i, found, label in ((i, assign(v), label) for i, v, label in kept)]
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((i, code, e, total[label], digest) for i, code, e, label in out)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, KIND) if isinstance(rows, list) else rows
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vc.vector_codes(df, **more).collect())


def test_against_whole_numbers_and_sql(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = found(spark, df.repartition(5))
    assert got == plain([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert got == sorted(db.execute(codes_sql()).fetchall())


def test_rows_that_are_left_out_ties_and_few_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.integers(-3, 3, 16) / 4096], k % 3 or None) for k in range(90)]  # small numbers: many ties
    rows += [(k, rows[0][1], 7) for k in range(200, 260)]  # copies
    bad = [(-1, None, 1), (-2, [None] * 16, 1), (-3, [math.nan] + [0.0] * 15, 1), (-4, [math.inf] + [0.0] * 15, 1), (-5, [-math.inf] + [0.0] * 15, None)]
    assert found(spark, rows + bad) == plain(rows + bad)
    odd = [(300, [1.0] * 8, 1), (301, [], 1), (302, [1.0] * 15, 1), (303, [1e300] * 16, 1)]  # another length, none, not in eight, no long
    assert found(spark, rows + odd) == plain(rows)
    assert found(spark, rows[:5]) == plain(rows[:5])  # fewer rows than entries
    assert found(spark, rows[:40], entries=3, rounds=2) == plain(rows[:40], 2, 3)
    assert found(spark, []) == [] and found(spark, bad) == []
    more = spark.createDataFrame([(*r, 1.5, "x") for r in rows], KIND + ", error double, id string")  # names that it makes itself
    assert found(spark, more) == plain(rows)


def test_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(0, 10.0**e, 8)], e) for e in (2, 5, 9) for k in range(100 * e, 100 * e + 20)]
    want = plain(rows)
    total = {r[0]: r[3] for r in want}
    fits = lambda x: x if x < 1 << 63 else None
    got = found(spark, rows)
    assert [(i, c, e, d) for i, c, e, _, d in got] == [(i, c, fits(e), d) for i, c, e, _, d in want]
    assert all(t == total[i] for i, _, _, t, _ in got if i < 500)


def test_labels_by_salt(spark, monkeypatch):
    rows = [(k, [float(k % 7)] * 8, k % 5 or None) for k in range(60)]
    want = found(spark, rows)
    monkeypatch.setattr(vc, "BROADCAST_IDS", 2)
    assert found(spark, rows) == want == plain(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 9), st.sampled_from([3, 60, 10**5, 2**27, 2**40]))
def test_nearest_is_exact(seed, d, wide):
    rng = np.random.default_rng(seed)
    c = rng.integers(-wide, wide, (6, d))
    x = np.concatenate([rng.integers(-wide, wide, (20, d)), c, (c[:3] + c[3:]) // 2, c + rng.integers(-1, 2, c.shape)])
    best, dist = vc.nearest(x, c)
    for row, b, e in zip(x.tolist(), best.tolist(), dist.tolist(), strict=True):
        assert (e, b) == min((sum((p - q) ** 2 for p, q in zip(row, y, strict=True)), k) for k, y in enumerate(c.tolist()))
