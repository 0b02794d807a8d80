"""Exact repeats and hashes against plain versions, with texts that break polynomial hashes, periodic ones and long ones."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from tomelight.llm.jaccard_join import jaccard_components
from tomelight.llm.substring_dedup import substring_dedup
from tomelight.llm.suffix_dedup import repeated_starts, suffix_dedup
from tomelight.llm.textkit import byte_hashes, ngram_hashes


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x[:n], x[:n].translate(str.maketrans("ab", "ba"))


def plain_starts(texts, size):
    often = Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    return np.array([k + size <= len(t) and often[t[k : k + size]] > 1 for t in texts for k in range(len(t))], bool)


def plain_dedup(texts, size):
    found, at = plain_starts(texts, size), 0
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in np.flatnonzero(found[at : at + len(t)]):
            gone[k : k + size] = True
        at += len(t)
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        yield len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_hashes_of_structured_texts():
    for n in (8, 64, 128, 256, 400, 512, 1024, 2048, 4096):
        a, b = thue_morse(n)
        data = np.frombuffer((a + b).encode(), np.uint8)
        x, y = byte_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        grams = ngram_hashes(byte_hashes(data, np.arange(2 * n), np.arange(1, 2 * n + 1)), n)
        assert x != y and grams[0] != grams[n]


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(120):
        signs = rng.choice([b"ab", b"abc\0", bytes(range(97, 123)), b"a"])
        base, texts = bytes(rng.choice(signs) for _ in range(rng.randrange(20, 600))), []
        for _ in range(rng.randrange(1, 8)):
            t = b""
            for _ in range(rng.randrange(0, 4)):
                x = rng.randrange(len(base))
                t += base[x : x + rng.randrange(1, 300)] + bytes(rng.choice(signs) for _ in range(rng.randrange(0, 40)))
            texts.append(t)
        size, offsets = rng.choice([8, 9, 13, 40, 100]), np.cumsum([0, *map(len, texts)])
        assert (repeated_starts(np.frombuffer(b"".join(texts), np.uint8), offsets, size) == plain_starts(texts, size)).all()


def test_suffix_dedup_at_full_size(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 11)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line, long = prose(200), prose(12), prose(300_000)
    texts = [prose(90) + shared[a : a + 700] + prose(30) for a in range(0, 600, 60)] + [f"{line}\n" * 40, f"x{line}\n" * 20, "of " * 900, "a of " + "of " * 300, *thue_morse(1024), "é" * 500 + shared]
    texts += [None, "", long, long[1_000_000:1_000_700] + prose(5)]
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string, sha string"), with_text=False).collect()}
    assert got == dict(enumerate(plain_dedup([(t or "").encode() for t in texts], 400)))


@pytest.mark.parametrize("n", [400, 1024, 4096])
def test_structured_words_are_not_equal(spark, n):
    a, b = thue_morse(n)
    more = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {more}"), (4, f"{b} {more}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_components(docs, 1).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()} == dict.fromkeys((1, 2, 3, 4), 0)


def test_large_block_with_few_links(spark, monkeypatch):
    monkeypatch.setattr("tomelight.llm.jaccard_join.drop", lambda df: None)  # the table of comparisons is looked at below
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60_000) for _ in range(2)]
    rng.shuffle(words)
    texts = [words[40 * k : 40 * k + 40] for k in range(3000)]  # each word in two texts, so that prefixes chain them all
    texts += [[*texts[k][:38], f"x{k}", f"y{k}"] for k in range(0, 30, 10)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    before = set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "tomelight").glob("both-*"))
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, 1, 80).collect()}
    assert got == {k: k for k in range(3000)} | {3000: 0, 3001: 10, 3002: 20}
    (both,) = set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "tomelight").glob("both-*")) - before
    rows = spark.read.parquet(str(both)).groupBy("block", "role").count().groupBy("block").pivot("role", [0, 1]).sum("count").collect()
    assert 3000 < sum(r["0"] * r["1"] for r in rows) < 300_000  # not 3000 * 3000
