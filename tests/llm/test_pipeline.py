"""Each stage of the pipeline against a plain version, and no operator is imported from outside the subpackage."""

import hashlib
import re
from pathlib import Path

from tokenizers import Tokenizer

import corpus_pipeline
from tomelight.llm.quality_classifier import fit_quality
from tomelight.llm.queries import held_out, word_vocabulary

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_quality(spark, rows):
    """Rows whose score is high enough, one text at a time."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~held_out()))
    return {i for i, t in rows if model.score([(t or "").encode()])[0] >= corpus_pipeline.QUALITY}


def plain_exact(rows):
    last = {}
    for i, t in rows:
        last[t] = max(i, last.get(t, i))
    return set(last.values())


def plain_near(rows):
    """Of the documents that links join, the one with the least id."""
    n, num = corpus_pipeline.SHINGLE, corpus_pipeline.SIMILAR
    sets = [{tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in (words(t) for _, t in rows)]
    head = list(range(len(rows)))

    def top(k):
        while head[k] != k:
            k = head[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                head[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(i, least.get(top(k), i))
    return set(least.values())


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def plain_benchmark(rows, items):
    """Rows of which no window of an item's length is within a fifth of the item's words in edits."""
    kept = set()
    for i, t in rows:
        w, held = words(t), False
        for item in items:
            n, most = len(item), len(item) // 5
            own = set(item)
            places = (k for k in range(len(w) - n + 1) if sum(x in own for x in w[k : k + n]) >= n - most)  # each edit takes one word away
            if n and any(distance(item, w[k : k + n]) <= most for k in places):
                held = True
                break
        if not held:
            kept.add(i)
    return kept


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = {"quality": lambda rows: plain_quality(spark, rows), "exact dedup": plain_exact, "near copies": plain_near, "benchmark": lambda rows: plain_benchmark(rows, items)}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept = {r.doc_id: r.text for r in docs.collect()}
        want = plain[name](sorted(texts.items()))
        assert docs.columns == columns and set(kept.items()) <= set(texts.items()) and len(kept) > 0.5 * len(texts), name
        assert set(kept) == want, name
        texts = kept
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    t = Tokenizer.from_str(word_vocabulary())
    t.no_truncation()
    t.no_padding()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for i, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in final} == want
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in final}


def test_nothing_imports_llm():
    for p in (ROOT / "tomelight").rglob("*.py"):
        assert "llm" in p.parts or not re.search(r"\bllm\b", p.read_text()), p  # as a word: fullmatch has these letters too
