"""Removal of word windows that an earlier document has, found by fixed-block anchors."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import golomb
from .exchange import PER_OWNER, Buckets, joined, lists, member, spans, whole
from .store import shards
from .textkit import U64, byte_hashes, chunks, inside, mix, ngram_hashes, words

#: Bytes of texts that one task looks at at a time, about.
BUCKET = 6 << 20


def _parts(texts: pa.Table):
    """Of runs of texts: the row of the first one, bytes, word starts and ends, the first word of each text, word hashes."""
    for a, _, data, offsets in chunks(texts.column("text")):
        starts, ends, first = words(data, offsets)
        yield a, data, starts, ends, first, byte_hashes(data, starts, ends)


def _anchors(first: np.ndarray, hashes: np.ndarray, n: int, block: int, bits: int):
    """Rolling windows of `block` words in texts of n words or more: fingerprints, where they lie in one text, whose text, and which are reference blocks."""
    grams = ngram_hashes(hashes, block) >> U64(64 - bits)
    lengths = np.diff(first)
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(grams)]
    ok = inside(first, block)[: len(grams)] & (lengths[text] >= n)
    aligned = (np.arange(len(grams)) - first[text]) % block == 0
    return grams, ok, text, ok & aligned


def _own(grams: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(grams ^ mix(text.astype(U64) + U64(1)))


def _probe(n: int, block: int, bits: int, owners: int):
    """To each owner: the distinct rolling windows of a bucket, and its reference blocks (apart those of several texts)."""

    def probe(table: pa.Table) -> pa.Table:
        texts = whole(table)
        rolling, blocks = [np.zeros(0, U64)], [np.zeros(0, U64)]
        for _, _, _, _, first, hashes in _parts(texts):
            grams, ok, text, index = _anchors(first, hashes, n, block, bits)
            rolling.append(np.unique(grams[ok]))
            _, once = np.unique(_own(grams[index], text[index]), return_index=True)
            blocks.append(grams[index][once])
        values = np.unique(np.concatenate(rolling))
        index, count = np.unique(np.concatenate(blocks), return_counts=True)
        out = []
        for owner, a, b in spans(values, bits, owners):
            x, y = np.searchsorted(index, [values[a], values[b - 1] + U64(1)]) if values[b - 1] < U64(2**64 - 1) else (np.searchsorted(index, values[a]), len(index))
            out.append((owner, golomb.encode(values[a:b]), golomb.encode(index[x:y]), golomb.encode(index[x:y][count[x:y] > 1])))
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"owner": pa.array([o[0] for o in out], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), **{c: pa.array([o[k] for o in out], pa.binary()) for k, c in enumerate(("rolling", "blocks", "several"), 1)}})

    return probe


def _hits(table: pa.Table) -> pa.Table:
    """Of each list of rolling windows, those that are reference blocks of one text, and of several."""
    blocks = [*lists(table.column("blocks")), *lists(table.column("several"))]
    index, count = np.unique(np.concatenate(blocks), return_counts=True)
    one, two = index[count == 1], index[count > 1]
    asked = lists(table.column("rolling"))
    return pa.table({"bucket": table.column("bucket"), "owner": table.column("owner"), **{c: pa.array([golomb.encode(x[member(x, found)]) for x in asked], pa.binary()) for c, found in (("one", one), ("two", two))}})


_SECOND = U64(0xD6E8FEB86659FD93)


def _seconds(hashes: np.ndarray, n: int) -> np.ndarray:
    """32 more bits of each window of n words, from other hashes of its words; with them a chance equality is one in 2**96."""
    return (ngram_hashes(mix(hashes ^ _SECOND), n) >> U64(32)).astype(np.uint32)


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def _unpack(column, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(zlib.decompress(x.as_py()), kind) for x in column)])


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _extend(n: int, block: int, bits: int, owners: int):
    """To each owner: the windows of n words round the hits, with the least id that has each in the bucket."""

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = whole(table)
        ids = texts.column("id").to_numpy()
        one, two = joined(answers.column("one")), joined(answers.column("two"))
        found, check, least = [np.zeros(0, U64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at, _, _, _, first, hashes in _parts(texts):
            grams, ok, text, index = _anchors(first, hashes, n, block, bits)
            hit = ok & member(grams, two)
            single = np.flatnonzero(ok & member(grams, one))
            foreign = ~member(_own(grams[single], text[single]), np.sort(_own(grams[index], text[index])))
            hit[single[foreign]] = True
            full = ngram_hashes(hashes, n)
            near = np.cumsum(np.concatenate([[0], hit]))
            p = np.flatnonzero(inside(first, n)[: len(full)])
            p = p[near[p + n - block + 1] > near[p]]
            found.append(full[p])
            check.append(_seconds(hashes, n)[p] if len(p) else check[0])
            least.append(ids[at + text[p]])
        values, check, ids = np.concatenate(found), np.concatenate(check), np.concatenate(least)
        order = np.lexsort((ids, check, values))
        values, check, ids = values[order], check[order], ids[order]
        head = _heads(values, check) if len(values) else np.zeros(0, np.int64)
        several = ids[np.append(head[1:], len(ids)) - 1] > ids[head] if len(values) else np.zeros(0, bool)
        values, check, ids = values[head], check[head], ids[head]
        out = [(owner, golomb.encode(values[a:b]), _pack(check[a:b]), np.packbits(several[a:b]).tobytes(), _pack(ids[a:b])) for owner, a, b in spans(values, 64, owners)]
        bucket = texts.column("bucket")[0].as_py() if texts.num_rows else 0
        return pa.table({"owner": pa.array([o[0] for o in out], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), **{c: pa.array([o[k] for o in out], pa.binary()) for k, c in enumerate(("windows", "check", "several", "least"), 1)}})

    return extend


def _repeats(table: pa.Table) -> pa.Table:
    """Of each list of windows, those of more than one id, with the least id of all."""
    asked = lists(table.column("windows"))
    values, check, ids = np.concatenate(asked), _unpack(table.column("check"), np.uint32), _unpack(table.column("least"), np.int64)
    several = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(v)) for x, v in zip(table.column("several"), asked, strict=True)]).astype(bool)
    order = np.lexsort((ids, check, values))
    head = _heads(values[order], check[order])
    size = np.diff(np.append(head, len(order)))
    least, last = ids[order][head], ids[order][head + size - 1]
    repeated = (least < last) | np.logical_or.reduceat(several[order], head)
    low, again = np.empty(len(order), np.int64), np.empty(len(order), bool)
    low[order], again[order] = np.repeat(least, size), np.repeat(repeated, size)
    out, k = [], 0
    for x in asked:
        own = k + np.flatnonzero(again[k : k + len(x)])
        k += len(x)
        out.append((golomb.encode(values[own]), _pack(check[own]), _pack(low[own])))
    return pa.table({"bucket": table.column("bucket"), "owner": table.column("owner"), **{c: pa.array([o[k] for o in out], pa.binary()) for k, c in enumerate(("windows", "check", "least"))}})


def _remove(n: int, with_text: bool):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = whole(table)
        ids = texts.column("id").to_numpy()
        windows = np.concatenate([np.zeros(0, U64), *lists(answers.column("windows"))])
        check, least = _unpack(answers.column("check"), np.uint32), _unpack(answers.column("least"), np.int64)
        order = np.lexsort((check, windows))
        windows, check, least = windows[order], check[order], least[order]
        out = {"sha": texts.column("sha").to_pylist(), "rep": ids.tolist(), "n_words": [], "n_removed": [], "kept_sha256": [], "all_sha256": [], "kept": []}
        for at, data, starts, ends, first, hashes in _parts(texts):
            full = ngram_hashes(hashes, n)
            p = np.flatnonzero(inside(first, n)[: len(full)])
            p = p[member(full[p], windows)]
            second = _seconds(hashes, n)[p] if len(p) else p
            k = np.searchsorted(windows, full[p])
            while len(behind := np.flatnonzero((k + 1 < len(windows)) & (windows[np.minimum(k + 1, len(windows) - 1)] == full[p]) & (check[k] < second))):  # a first half that two windows share
                k[behind] += 1
            text = np.searchsorted(first, p, "right") - 1
            gone = p[(check[k] == second) & (least[k] < ids[at + text])]
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + n, -1)
            covered = np.cumsum(cover)[: len(starts)] > 0
            raw = data.tobytes()
            for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                parts = [raw[s:e] for s, e in zip(starts[x:y].tolist(), ends[x:y].tolist(), strict=True)]
                kept = b" ".join([w for w, c in zip(parts, covered[x:y].tolist(), strict=True) if not c])
                out["n_words"].append(y - x)
                out["n_removed"].append(int(covered[x:y].sum()))
                out["kept"].append(kept.decode("utf-8", "replace") if with_text else None)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["all_sha256"].append(hashlib.sha256(b" ".join(parts)).hexdigest())
        return pa.table(out, schema=pa.schema([("sha", pa.binary()), ("rep", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("all_sha256", pa.string()), ("kept", pa.string())]))

    return remove


def substring_dedup(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 and (with_text) kept, the words that stay joined by one space.

    Words are split at ASCII white space and compared unchanged. Every word is removed that lies in a window
    of n words which also starts in a document with a smaller id. Null and empty texts have no words; texts of
    fewer than n words lose nothing; a null id is smaller than all others; rows that repeat an id never take
    from each other; an empty table gives an empty result; other columns are not looked at. Windows are
    compared by two hashes of 96 bits together, which no structure of texts makes equal (finalised steps over words).

    Reference blocks of (n + 1) // 2 words, end to end from each text's start, are the index; whatever window
    repeats holds one of them whole. Every rolling window of that length probes it. The windows of n words
    round the hits then find the least document that has each, and those of a later document are joined to
    maximal repeats. Equal texts are looked at once. Fingerprints travel sorted and Golomb-coded, one list for
    each bucket of texts and owner, so a passage that all documents share is one value for each bucket.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts, block = Buckets(docs, id_col, text_col, BUCKET), (n + 1) // 2
    bits = min(64, max(32, texts.n_bytes.bit_length() + 6))  # a false hit costs a comparison, no more
    owners = shards(docs.sparkSession, texts.n_bytes / 5, PER_OWNER)
    groups = texts.texts.groupBy("bucket")
    hits = groups.applyInArrow(_probe(n, block, bits, owners), "owner int, bucket int, rolling binary, blocks binary, several binary").groupBy("owner").applyInArrow(_hits, "bucket int, owner int, one binary, two binary")
    windows = groups.cogroup(hits.groupBy("bucket")).applyInArrow(_extend(n, block, bits, owners), "owner int, bucket int, windows binary, check binary, several binary, least binary")
    repeats = windows.groupBy("owner").applyInArrow(_repeats, "bucket int, owner int, windows binary, check binary, least binary")
    found = groups.cogroup(repeats.groupBy("bucket")).applyInArrow(_remove(n, with_text), "sha binary, rep long, n_words long, n_removed long, kept_sha256 string, all_sha256 string, kept string")
    out = texts.spread(found if with_text else found.drop("kept"))
    copy, long = F.col("id") > F.col("rep"), F.col("n_words") >= n
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    columns = [
        F.when(F.col("id") > -(2**63), F.col("id")).cast(kind).alias(id_col),
        "n_words",
        F.when(copy, F.when(long, F.col("n_words")).otherwise(0)).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(copy & long, empty).when(copy, F.col("all_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    return out.select(*columns, *([F.when(copy & long, "").otherwise(F.col("kept")).alias("kept")] if with_text else []))
