"""Secrets in whole texts: fixed patterns, and strings that a character model of random strings explains best."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import as_binary

# The patterns of the base kinds and their least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs, as + and a length of 24 would give
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: What the models look at: runs of these characters, of this length at least.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9+/_=-]{3,}")
#: Texts that labelled strings are taken from (those with the least hash of id and text; copies of a row count once),
#: strings of each class and source, and characters of a string, at most.
SAMPLE, STRINGS, LONGEST = 400, 20_000, 200
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = {c: k for k, c in enumerate(_ALPHABET)}
_START = len(_ALPHABET)


def random_strings(n: int = STRINGS, seed: int = 7) -> list[str]:
    """Secrets made by rule: base-64, hexadecimal and alphanumeric keys of usual lengths."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        raw = rng.randbytes(rng.randrange(12, 48))
        out.append((base64.b64encode(raw).decode().rstrip("="), raw.hex(), "".join(rng.choices(_ALPHABET[:62], k=len(raw))), "".join(rng.choices(_ALPHABET[:26] + _ALPHABET[52:62], k=len(raw))))[k % 4])
    return out


def identifiers(words: list[str], n: int = STRINGS, seed: int = 11) -> list[str]:
    """Compound identifiers of ordinary words: snake, kebab, path and camel case, with and without a number."""
    rng, out = random.Random(seed), []
    for k in range(n if words else 0):
        parts = [rng.choice(words) for _ in range(rng.randrange(2, 5))]
        if k % 4 == 3:
            parts[1:] = [x.capitalize() for x in parts[1:]]
        out.append("_-/"[k % 4 : k % 4 + 1].join(parts) + (str(rng.randrange(2100)) if rng.randrange(3) == 0 else ""))
    return out


def _model(strings: list[str]) -> np.ndarray:
    """Log-probabilities of a character after another (first-order Markov chain, add-one smoothed)."""
    counts = np.ones((_START + 1, _START))
    for s in strings:
        codes = [_CODE[c] for c in s if c in _CODE]
        np.add.at(counts, ([_START, *codes[:-1]], codes), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def eligible(run: str) -> bool:
    """Whether the models look at a run: it has letters, and digits or changes of case."""
    digits, letters = sum(c.isdigit() for c in run), sum(c.isalpha() for c in run)
    return letters >= 4 and (digits >= 2 or sum(a.islower() and b.isupper() for a, b in zip(run, run[1:], strict=False)) >= 2)


@dataclass
class SecretModel:
    ratio: np.ndarray  # log-likelihood ratio of each step
    threshold: float = 0.0  # mean ratio a character from which a run is a secret
    precision: float = 1.0  # both on the strings that were held out
    recall: float = 1.0

    def score(self, s: str) -> float:
        codes = [_CODE[c] for c in s]
        return float(self.ratio[[_START, *codes[:-1]], codes].mean())


def _held(s: str) -> bool:
    return zlib.crc32(s.encode()) % 5 == 0


def train(secrets: list[str], ordinary: list[str]) -> SecretModel:
    """Chains of four fifths of two labelled lists; the threshold with the best F1 on the eligible strings of the other fifth."""
    model = SecretModel(_model([x for x in secrets if not _held(x)]) - _model([x for x in ordinary if not _held(x)]))
    held = [(model.score(x), y) for some, y in ((secrets, 1), (ordinary, 0)) for x in some if _held(x) and CANDIDATE.fullmatch(x) and eligible(x)]
    if held:
        held.sort(reverse=True)
        scores, y = np.array([x for x, _ in held]), np.array([y for _, y in held])
        hits, asked, wanted = np.cumsum(y), np.arange(1, len(y) + 1), max(1, y.sum())
        last = np.append(scores[1:] != scores[:-1], True)
        k = int(np.argmax(np.where(last, 2 * hits / (asked + wanted), -1)))
        model.threshold, model.precision, model.recall = float(scores[k] + (scores[k + 1] if k + 1 < len(y) else scores[k])) / 2, float(hits[k] / asked[k]), float(hits[k] / wanted)
    return model


def labelled(text: str) -> tuple[set[str], set[str]]:
    """The strings of a text that a base pattern marks as secret, and its ordinary words (those that no base span touches)."""
    base, secrets = base_spans(text), set()
    for a, kind, b in base:
        value = ASSIGN.match(text, a)[2] if kind == 0 else text[a:b]
        secrets.add(value)
    cover = _Cover(base)
    return {x for x in secrets if len(x) <= LONGEST}, {m[0] for m in _WORD.finditer(text) if len(m[0]) <= LONGEST and not cover.touches(m.start(), m.end())}


def fit_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SecretModel:
    """Train on labelled strings: secrets are the values that base patterns mark in SAMPLE texts and keys made by rule,
    ordinary are the other words of these texts and compounds of them. Strings are taken on the executors and are
    bounded in number and length. A table without texts gives a model of the made keys alone.
    """
    docs = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row")).where("text is not null")
    picked = docs.select("row").distinct().orderBy("row").limit(SAMPLE).agg(F.max("row")).first()[0]  # one number
    if picked is None:
        return train(random_strings(), [])

    def strings(batches):
        for batch in batches:
            found = [labelled(x.as_py().decode("utf-8", "replace")) for x in as_binary(batch.column(0))]
            rows = sorted({(x, y) for f in found for y in (0, 1) for x in f[1 - y]})
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int32())], ["s", "y"])

    found = docs.where(F.col("row") <= picked).select("text").mapInArrow(strings, "s string, y int").distinct()
    rows = [r for y in (1, 0) for r in found.where(F.col("y") == y).orderBy(F.xxhash64("s"), "s").limit(STRINGS).collect()]
    ordinary = sorted(r.s for r in rows if not r.y)
    return train([*random_strings(), *sorted(r.s for r in rows if r.y)], [*ordinary, *identifiers([w for w in ordinary if w.isalpha()])])


class _Cover:
    """Some spans, merged, for asking whether another touches one."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for a, _, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, leftmost and non-overlapping within a kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str, model: SecretModel, scores: dict[str, float]) -> tuple[list, list]:
    """The base spans, and all spans: a run that no base span touches is added if the models say so."""
    base = base_spans(text)
    cover, more = _Cover(base), []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if run not in scores:
            scores[run] = model.score(run) if eligible(run) else -np.inf
        if scores[run] >= model.threshold and not cover.touches(m.start(), m.end()):
            more.append((m.start(), 3, m.end()))
    return base, sorted(base + more)


def _written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points, comma-joined).

    Null and empty texts have no spans; repeated rows and null ids come back as they are; an empty table gives an
    empty result; other columns are not looked at. Whole texts are scanned, each by itself.
    """
    docs = docs.select(F.col(id_col), F.col(text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of 68 by 67 numbers

    def run(batches):
        scores: dict[str, float] = {}
        for batch in batches:
            out = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
            for text in as_binary(batch.column(1)):
                if len(scores) > 200_000:
                    scores.clear()
                base, spans = scan(text.as_py().decode("utf-8", "replace"), shared.value, scores)
                for k, c in enumerate(("n_assign", "n_access", "n_hex")):
                    out[c].append(sum(x[1] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(_written(base).encode()).hexdigest())
                out["spans"].append(_written(spans))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], [id_col, *out])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
