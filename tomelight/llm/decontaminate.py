"""Benchmark passages in documents: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit distance."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .exchange import member
from .store import durable, restrict, row_key, unused
from .textkit import U64, byte_hashes, chunks, give_back, lower, mix, ngram_hashes, ragged, words

#: Walks, samples of each walk and symbols of a sample. Windows within the distance share a sample with probability
#: 0.95 at least if half of the symbols of a walk differ, and nearly always with fewer.
WALKS, SAMPLES, SYMBOLS = 4, 16, 4
#: Items, and bytes of items, that one pass over the documents asks for, about; more are asked for in several passes.
ITEMS, ITEM_BYTES = 20_000, 32 << 20
#: Symbols of embeddings that are held at a time, about.
EMBEDDED = 1 << 21
_PAD = U64(0x7C15F39CC0605CED)


class Items:
    """A block of benchmark items: their words and pairs of words, and the LSH tables of the embeddings of each size."""

    def __init__(self, ids: list[int], texts: list[str], num: int, den: int):
        self.ids, self.sets, known = [], [], [np.zeros(0, U64)]
        for a, b, data, offsets in chunks(pa.array(texts, pa.string())):
            starts, ends, first = words(lower(data), offsets)
            h = byte_hashes(lower(data), starts, ends)
            for k in range(b - a):
                if first[k + 1] > first[k]:
                    self.ids.append(ids[a + k])
                    self.sets.append(h[first[k] : first[k + 1]])
                    known.append(ngram_hashes(self.sets[-1], 2))
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.edits = self.sizes * num // den
        self.words, self.pairs = np.unique(np.concatenate([*self.sets, known[0]])), np.unique(np.concatenate(known))
        self.marks = np.zeros(len(self.pairs), U64)  # of each pair, the sizes modulo 64 of the items that have it
        for s in self.sets:
            self.marks[np.searchsorted(self.pairs, ngram_hashes(s, 2))] |= U64(1 << len(s) % 64)
        self.tables = {}
        for n in np.unique(self.sizes).tolist():
            own = np.flatnonzero(self.sizes == n)
            keys = np.concatenate([lsh_keys(np.stack([self.sets[k] for k in some])) for some in np.array_split(own, -(-len(own) // rows_at_once(n)))])
            order = np.argsort(keys, axis=0)
            different = min(len(np.unique(ngram_hashes(self.sets[k], 2))) for k in own)
            self.tables[n] = n * num // den, own[order].T.copy(), np.take_along_axis(keys, order, 0).T.copy(), different


def rows_at_once(n: int) -> int:
    """Windows of n words that are embedded at a time."""
    return max(1, EMBEDDED // (3 * n))


def cgk(windows: np.ndarray, walk: int) -> np.ndarray:
    """The embeddings (rows of 3n symbols) of windows of n words: a walk that stays or goes on by a random bit of step and word."""
    rows, n = windows.shape
    padded = np.concatenate([windows, np.full((rows, 1), _PAD)], axis=1)
    at, out, line = np.zeros(rows, np.int64), np.empty((rows, 3 * n), U64), np.arange(rows)
    for j in range(3 * n):
        symbol = padded[line, at]
        out[:, j] = symbol
        at = np.minimum(at + (mix(symbol ^ mix(np.array([j * WALKS + walk + 1], U64))) & U64(1)).astype(np.int64), n)
    return out


def lsh_keys(windows: np.ndarray) -> np.ndarray:
    """Of each window, the keys of WALKS * SAMPLES bit samples of its embeddings; equal keys in a column are a candidate."""
    n = windows.shape[1]
    out = []
    for walk in range(WALKS):
        embedded = cgk(windows, walk)
        picks = np.random.default_rng(1000 * n + walk).integers(0, 3 * n, (SAMPLES, SYMBOLS))
        for p in picks:
            key = np.zeros(len(windows), U64)
            for c in p.tolist():
                key = mix(key * U64(31) + embedded[:, c])
            out.append(key)
    return np.stack(out, axis=1)


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Edits between two word sequences, most + 1 if more (Myers' bit vectors)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    if not a:
        return len(b)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for x in b:
        match = places.get(x, 0)
        d0 = ((((match & up) + up) ^ up) | match | down) & full
        plus, minus = down | (~(d0 | up) & full), up & d0
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | (~(d0 | plus) & full), plus & d0
    return min(score, most + 1)


def _windows(items: Items, hashes: np.ndarray, first: np.ndarray):
    """(window length, starts): the item-sized windows, but for those with too few words or pairs of words of any item.

    Each edit takes one word and two pairs of an item away, so a window within k edits of n words has n - k of its
    words, n - 1 - 2k of its pairs, and all but 2k of its different pairs, which some item of that size has. That leaves
    no near window out, and names no item."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    one = member(hashes, items.words)
    two = np.zeros(len(hashes), bool)
    both = np.flatnonzero(one[:-1] & one[1:])
    pairs = ngram_hashes(hashes, 2)
    two[both] = member(pairs[both], items.pairs)
    known = np.flatnonzero(two)
    marks, before = np.zeros(len(hashes), U64), np.full(len(hashes), -1)  # before: the last place with the same pair
    marks[known] = items.marks[np.searchsorted(items.pairs, pairs[known])]
    known = known[np.argsort(pairs[known], kind="stable")]
    again = np.flatnonzero(pairs[known[1:]] == pairs[known[:-1]])
    before[known[again + 1]] = known[again]
    one, two = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (one, two))
    for n, (edits, _, _, different) in items.tables.items():
        m = len(hashes) - n + 1
        if m <= 0:
            continue
        p = np.flatnonzero((two[n - 1 : n - 1 + m] - two[:m] >= n - 1 - 2 * edits) & (one[n : n + m] - one[:m] >= n - edits))
        p = p[text[p] == text[p + n - 1]]
        kept = [p[:0]]
        for x in np.array_split(p, 1 + len(p) // rows_at_once(n)):
            at = x[:, None] + np.arange(n - 1)
            new = (marks[at] >> U64(n % 64) & U64(1)).astype(bool) & (before[at] < x[:, None])
            kept.append(x[new.sum(1) >= different - 2 * edits])
        p = np.concatenate(kept)
        if len(p):
            yield n, p


def _near(items: Items, n: int, windows: np.ndarray) -> list[tuple[int, int, int]]:
    """(window, item, distance) of the windows of n words that an LSH table brings to an item within its edits."""
    most, own, keys, _ = items.tables[n]
    asked, pairs = lsh_keys(windows), set()
    for c in range(len(keys)):
        x, y = np.searchsorted(keys[c], asked[:, c]), np.searchsorted(keys[c], asked[:, c], "right")
        hit = np.flatnonzero(y > x)
        if len(hit):
            pairs.update(zip(np.repeat(hit, y[hit] - x[hit]).tolist(), own[c][ragged(x[hit], y[hit] - x[hit])].tolist(), strict=True))
    found = ((q, k, edit_distance(items.sets[k].tolist(), windows[q].tolist(), most)) for q, k in pairs)
    return [x for x in found if x[2] <= most]


def _search(shared):
    def search(batches):
        items: Items = shared.value
        for batch in batches:
            names = batch.column(0).to_pylist()
            best: dict[tuple[int, int], tuple[int, int, int]] = {}  # of each text and item: distance, first word, words
            waiting: dict[int, list] = {}

            def settle(n: int) -> None:
                """Ask for all windows of n words that wait, so that few calls embed many."""
                windows, text, place = (np.concatenate(x) for x in zip(*waiting.pop(n), strict=True))
                for lo in range(0, len(text), rows_at_once(n)):
                    for q, k, d in _near(items, n, windows[lo : lo + rows_at_once(n)]):
                        key, now = (int(text[lo + q]), k), (d, int(place[lo + q]), n)
                        best[key] = min(now, best.get(key, now))

            for a, _, data, offsets in chunks(batch.column(1)):
                data = lower(data)
                starts, ends, first = words(data, offsets)
                hashes = byte_hashes(data, starts, ends)
                for n, found in _windows(items, hashes, first):
                    for p in np.array_split(found, 1 + len(found) // rows_at_once(n)):
                        text = np.searchsorted(first, p, "right") - 1
                        waiting.setdefault(n, []).append((hashes[p[:, None] + np.arange(n)], a + text, p - first[text]))
                        if sum(len(x[1]) for x in waiting[n]) >= rows_at_once(n):
                            settle(n)
            for n in list(waiting):
                settle(n)
            out = [(names[text], items.ids[k], p, p + n, d, 1 - d / n) for (text, k), (d, p, n) in sorted(best.items())]
            kinds = (batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["id", "item_id", "first_word", "end_word", "distance", "similarity"])
        give_back()

    return search


def find_items(docs: DataFrame, benchmark: DataFrame, num: int = 20, den: int = 100, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: id, item_id, first_word, end_word, distance, similarity.

    A document holds an item if a window of as many words as the item has is within num / den of these words in edits
    (words split at ASCII white space, A-Z lower-cased); the nearest such window, then the first, is returned. Null
    and empty texts, and items without words, match nothing; repeated rows each match; null ids of either table come back as null; an
    empty table gives an empty result; other columns are not looked at.

    The walks of CGK embed every item and every window of an item's size (windows with too few words or pairs of words
    of all items together are left out first, as no item can be near them), so that few edits become few differing
    symbols. Windows and items that have an equal bit sample of an embedding are candidates (LSH, a miss with
    probability below 0.05), and are compared exactly. Tests measure the recall against all windows. The benchmark is
    asked for in blocks of ITEMS items; each is sent to every executor, and given back before the next.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    asked = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks, parts = max(1, -(-n // ITEMS), -(-size // ITEM_BYTES)), []
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        shared = docs.sparkSession.sparkContext.broadcast(Items([r.item for r in rows], [r.text for r in rows], num, den))
        hits = docs.mapInArrow(_search(shared), f"id {kind}, item_id long, first_word long, end_word long, distance long, similarity double")
        if blocks > 1:
            hits = durable(hits, "hits")
            shared.unpersist()
        parts.append(hits)
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that hold a benchmark item; other rows of the same id, or of a null one, stay."""
    row = unused(docs, "__row")
    docs = docs.withColumn(row, row_key(id_col, text_col))
    held = durable(find_items(docs, benchmark, id_col=row, text_col=text_col, **options).select(row).distinct(), "held")
    return restrict(docs, held, row, "left_anti").drop(row)
