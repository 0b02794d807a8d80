"""Secrets: base columns of a whole table against a scanner without regular expressions; the models' precision and recall."""

import hashlib
import random
import string

from tomelight.llm.secret_scan import find_secrets, fit_secrets, identifiers, random_strings, scan, train

KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")
UPPER, HEX = set(string.ascii_uppercase + string.digits), set("0123456789abcdef")


def run(text, at, signs):
    while at < len(text) and text[at] in signs:
        at += 1
    return at


def assign(text, at):
    """(start of the value, end) of an assignment at `at`, or None; optional parts are given up as a regular expression would."""
    low = "".join(c.lower() if c in string.ascii_letters else c for c in text[at : at + 8])
    for key in KEYS:
        if low.startswith(key):
            x = at + len(key)
            x += text[x : x + 1] in ("'", '"') and x < len(text)
            x = run(text, x, " ")
            if text[x : x + 1] in (":", "="):
                x = run(text, x + 1, " ")
                x += text[x : x + 1] in ("'", '"') and x < len(text)
                end = run(text, x, VALUE)
                if end > x:
                    return x, end
    return None


def plain(text):
    out, at = [], 0
    while at < len(text):
        found = assign(text, at) if text[at] in "pPsStTaA" else None
        if found:
            out += [(at, 0, found[1])] if found[1] - found[0] >= 6 else []
        at = found[1] if found else at + 1
    at = text.find("AKIA")
    while at >= 0:
        end = run(text, at + 4, UPPER)
        out += [(at, 1, end)] if end - at >= 20 else []
        at = text.find("AKIA", end if end > at + 4 else at + 1)
    at = 0
    while at < len(text):
        end = run(text, at, HEX)
        out += [(at, 2, end)] if end - at >= 24 else []
        at = max(end, at + 1)
    return sorted(out)


def test_base_columns_of_a_whole_table(spark):
    rng = random.Random(6)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    parts = ["password", "TOKEN", "apikey", "api_key", "secret", "'", '"', " ", "  ", ":", "=", "==", "abc", "hunter22", "AKIA", "ABCDEFGHIJKLMNOP", "AKIAAKIA", "deadbeef", "0123456789abcdef", "é", "x.y", "\n"]
    made = spark.createDataFrame([(10**6 + k, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 60)))) for k in range(600)], "doc_id long, text string")
    both = table.unionByName(made)
    model = fit_secrets(table)
    texts = {r.doc_id: r.text for r in both.collect()}
    for r in find_secrets(both, model).collect():
        base = plain(texts[r.doc_id] or "")
        written = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3)), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest() and set(written) <= set(filter(None, r.spans.split(",")))


def test_precision_and_recall(spark):
    model = fit_secrets(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert model.precision > 0.98 and model.recall > 0.98
    words = "user account email address billing invoice customer order service handler request response session config default value index parent child render update create delete list".split()
    keys, names = random_strings(400, seed=99), identifiers(words, 400, seed=98)
    found = lambda s: bool(scan(f"say {s} here", model, {})[1])
    keys = [k for k in keys if len(k) >= 16 and any(c.isdigit() for c in k)]
    assert sum(map(found, keys)) > 0.95 * len(keys) and sum(map(found, names)) < 0.05 * len(names)
    assert train(["a1B2"], []).threshold == 0.0


def test_long_text_with_many_spans():
    text = " ".join(f"{k:024x} Ab{k}xYz{k * 7919}Qw{k * 104729}" for k in range(20_000))
    base, spans = scan(text, train(random_strings(), []), {})
    assert len(base) == 20_000 and len(spans) >= len(base)
