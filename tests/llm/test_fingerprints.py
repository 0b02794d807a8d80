"""Fingerprints: contract columns against plain Python, likeness against true similarities, bands against all pairs."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from tomelight.llm import fingerprints as fp
from tomelight.llm.queries import op13_document_fingerprints

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    """(doc_id, n_chars, edited digest, edited text, next text) of each row, ids unlike."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 2
        edited = text[: len(text) - n] + after[:n]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, after))
    return out


def check(found, rows):
    found, want = {r.doc_id: r for r in found}, plain(rows)
    assert len(found) == len(want)
    for i, n, sha, text, edited, after in want:
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha), i
        sign = lambda t: fp._texts(fp.signatures(pa.array([t])))[0]
        assert (r.fingerprint, r.edited_fingerprint) == (sign(text), sign(edited))
        for got, other in ((r.near_edited, edited), (r.near_next, after)):
            assert abs(got - similar(grams(text), grams(other))) < 0.2  # 4 to 5 standard errors of 128 values
    return found


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = check(op13_document_fingerprints(spark, SF).collect(), rows)
    error = [r.near_edited - similar(grams(t), grams(e)) for r, t, e in ((found[i], t, e) for i, _, _, t, e, _ in plain(rows))]
    assert abs(np.mean(error)) < 0.01


def test_edges(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    rows = [(9, None), (8, ""), (7, " \n"), (6, "é"), (5, "日本語のテキスト"), (4, text(60_000) * 3), (3, "a b c"), (2, "A B C"), (-1, text(4)), (None, text(30)), (2**60, text(40))]
    rows += [(k, text(rng.randrange(30))) for k in range(100, 160)]
    found = check(fp.fingerprints(spark.createDataFrame(rows, KIND).repartition(6)).collect(), rows)
    assert found[9].fingerprint == found[8].fingerprint == found[7].fingerprint and found[9].near_next == 1
    assert found[3].fingerprint == found[2].fingerprint
    alone = fp.fingerprints(spark.createDataFrame([(1, "one two three four")], KIND)).first()
    assert alone.edited_sha256 == hashlib.sha256(b"one two tone two t"[:9] + b"one two t").hexdigest() and alone.near_next == 1
    empty = fp.fingerprints(spark.createDataFrame([], KIND))
    assert empty.count() == 0 and empty.columns[:3] == ["doc_id", "n_chars", "edited_sha256"]
    more = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], KIND + ", signs string, part int, near_next double")
    assert {r.doc_id: r for r in fp.fingerprints(more).collect()} == found


def test_repeated_ids_are_rows(spark):
    rows = [(5, "a b c d e f")] * 40 + [(5, None), (None, "x y"), (None, "x z"), (4, "q")]
    got = fp.fingerprints(spark.createDataFrame(rows, KIND).repartition(4)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    assert sum(r.near_next == 1 for r in got) >= 39  # a copy's next is a copy


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice((6, 40, 200)))] for _ in range(12)]
    rows = []
    for k in range(240):
        own = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            own[rng.randrange(len(own))] = f"w{rng.randrange(400)}"
        rows.append((k, " ".join(own)))
    rows += [(500, None), (501, ""), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, KIND).repartition(5)
    got = {(r.query_id, r.id): r.jaccard for r in fp.near_copies(docs, docs.where("doc_id % 5 = 0")).collect()}
    first = {}
    for i, t in rows:
        if i is not None and t:
            first[t] = min(i, first.get(t, i))
    asked = {}
    for i, t in rows:
        if i is not None and t and i % 5 == 0:
            asked[t] = min(i, asked.get(t, i))
    want = {(a, b): similar(grams(x), grams(y)) for x, a in asked.items() for y, b in first.items() if a != b and similar(grams(x), grams(y)) >= 0.8}
    assert got == want and len(want) > 60
