"""Decoding of label sequences against all paths; contexts of question records; sources that fail."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa

from tomelight.operators import labelling as L
from tomelight.plans import curation, text  # noqa: F401  they register their queries
from tomelight.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_crf_decode_against_all_paths(spark):
    rng = np.random.default_rng(7)
    step, start, end = rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    rows = [(k, rng.normal(0, 2, (int(rng.integers(0, 7)), 3)).tolist()) for k in range(60)] + [(100, None), (101, []), (102, [[1e4, 0.0, -1e4]] * 3)]
    df = spark.createDataFrame(rows, "id long, x array<array<double>>").repartition(3)
    got = {r.id: (r.path, r.confidence) for r in L.crf_decode(df, "x", step.tolist(), start.tolist(), end.tolist()).collect()}
    assert len(got) == len(rows)
    for k, x in rows:
        path, sure = got[k]
        if not x:
            assert (path, sure) == ([], [])
            continue
        score = lambda p: start[p[0]] + end[p[-1]] + sum(x[i][c] for i, c in enumerate(p)) + sum(step[a, b] for a, b in itertools.pairwise(p))  # noqa: E731, B023
        every = {p: score(p) for p in itertools.product(range(3), repeat=len(x))}
        top = max(every.values())
        assert abs(every[tuple(path)] - top) < 1e-9
        weight = {p: math.exp(s - top) for p, s in every.items()}
        for i, (c, s) in enumerate(zip(path, sure, strict=True)):
            assert abs(s - sum(w for p, w in weight.items() if p[i] == c) / sum(weight.values())) < 1e-9


def test_answers_stand_in_their_context(spark):
    rows = QUERIES["q_export_squad"](spark, SF).collect()
    assert rows and all(r.context[r.answer_start : r.answer_start + len(r.answer)] == r.answer for r in rows)
    kinds = {r.impossible for r in QUERIES["q_export_negatives"](spark, SF).collect()}
    assert True in kinds


def plain_path(x, step, start, end):
    """The best path, one label at a time; of equal scores the least label."""
    kinds = range(len(step))
    best, came = [start[j] + x[0][j] for j in kinds], []
    for row in x[1:]:
        came.append([max(kinds, key=lambda i: best[i] + step[i][j]) for j in kinds])  # noqa: B023
        best = [best[came[-1][j]] + step[came[-1][j]][j] + row[j] for j in kinds]
    path = [max(kinds, key=lambda j: best[j] + end[j])]
    for back in reversed(came):
        path.append(back[path[-1]])
    return path[::-1]


def test_viterbi_counts_start_end_and_missing_scores(spark):
    rng = np.random.default_rng(9)
    step, start, end = (rng.normal(size=s).round(2).tolist() for s in ((3, 3), 3, 3))
    rows = [(k, rng.normal(0, 1, (int(rng.integers(1, 7)), 3)).round(2).tolist()) for k in range(60)]
    rows += [(60, [[1.0, None, 0.5], [0.5], None, [0.1, 0.2, 0.3, 9.0]]), (61, []), (62, None)]
    df = spark.createDataFrame(rows, "id long, x array<array<double>>").repartition(3)
    got = {r.id: r.path for r in L.viterbi(df, "x", step, start=start, end=end).collect()}
    bare = {r.id: r.path for r in L.viterbi(df, "x", step).collect()}
    assert got != bare
    for k, x in rows:
        full = [[((r or [])[j : j + 1] or [0])[0] or 0 for j in range(3)] for r in x or []]
        assert got[k] == (plain_path(full, step, start, end) if full else [])
        assert bare[k] == (plain_path(full, step, [0] * 3, [0] * 3) if full else [])


def test_viterbi_query_against_a_plain_one(spark):
    got = {r.doc_id: (r.n, r.ones) for r in QUERIES["q_viterbi"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        x = [[len(w) / 10.0, 1.0 if re.search("[.,]$", w) else 0.0] for w in re.split(r"[ \t\n\x0b\f\r]+", text)] if text is not None else []
        path = plain_path(x, [[0.5, 0.0], [0.2, -1.0]], [0.2, -0.5], [-0.3, 0.4]) if x else []
        assert got[doc_id] == (len(path), sum(path))


def test_bio_tags_are_decoded_together(monkeypatch):
    def plain(row):
        out, open_ = [], None
        for k, tag in enumerate(row or []):
            head, _, kind = (tag or "O").partition("-")
            if head == "B" or (head == "I" and open_ is not None and open_["type"] != kind):
                open_ = {"type": kind, "first": k, "last": k}
                out.append(open_)
            elif head == "I" and open_ is not None:
                open_["last"] = k
            elif head != "I":
                open_ = None
        return out

    rng, asked = np.random.default_rng(1), []
    for names in (["O", "B-A", "I-A", "B-B", "I-B", None, "", "B", "I", "X-A", "B-A-C"], ["I-A", "O"], ["B-A"], [None]):
        rows = [None if k % 17 == 3 else [names[i] for i in rng.integers(0, len(names), int(rng.integers(0, 12)))] for k in range(1500)]
        found = L.bio_entities.func(pa.array(rows, pa.list_(pa.string())).slice(5))
        assert found.to_pylist() == [plain(r) for r in rows[5:]]
    assert L.bio_entities.func(pa.array([], pa.list_(pa.string()))).to_pylist() == []
    decoded = L._decoded
    monkeypatch.setattr(L, "_decoded", lambda x: asked.append(len(x)) or decoded(x))
    L.bio_entities.func(pa.array([["B-A"]] * 600, pa.list_(pa.string())))
    assert asked == [256, 256, 88]  # some hundred rows at a time, not each tag by itself
