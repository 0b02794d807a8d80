"""Removal of repeated byte strings by prefix-free parsing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import golomb
from .exchange import PER_OWNER, Buckets, joined, lists, member, spans, whole
from .store import durable, shards
from .textkit import U64, byte_hashes, chunks, eights, mix

#: Bytes of texts that one task looks at at a time, about.
BUCKET = 4 << 20
#: Bytes of a trigger, and one window in so many is one: the mean length of a phrase.
TRIGGER, PHRASE = 8, 32
#: Strings go one way by where their phrase lies in them, in steps of so many bytes: a phrase of very many strings has several owners.
STEP = 128
#: Bytes of stretches that one owner gets, and that are put in order at a time, about.
STRETCHES, PART = 8 << 20, 1 << 20


def triggers(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where triggers start: 8-byte windows inside a text whose hash is 0 modulo PHRASE. They depend on these bytes only."""
    at = np.flatnonzero(mix(eights(data)[: max(0, len(data) - TRIGGER + 1)] * U64(0x9E3779B97F4A7C15)) % U64(PHRASE) == 0)
    return at[np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + TRIGGER - 1, "right")]


def _phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the whole phrases: from a trigger to the end of the next one in the same text."""
    at = triggers(data, offsets)
    text = np.searchsorted(offsets, at, "right")
    same = text[1:] == text[:-1]
    a, b = at[:-1][same], at[1:][same] + TRIGGER
    return a, b, byte_hashes(data, a, b)


def suffix_ranks(rank: np.ndarray, rest: np.ndarray, depth: int, most: int) -> np.ndarray:
    """The rank of every suffix among all, by prefix doubling.

    rank: the order of the suffixes by their first `depth` entries, as the number of smaller ones; rest: how many
    entries each has (an end comes before every entry). Suffixes that agree in `most` entries or to their ends share a rank.
    """
    rank = rank.copy()
    while depth < most:
        size = np.bincount(rank, minlength=len(rank))
        live = np.flatnonzero((size[rank] > 1) & (rest >= depth))
        if not len(live):
            break
        after = np.where(rest[live] > depth, rank[np.minimum(live + depth, len(rank) - 1)], -1)
        key = rank[live] * (len(rank) + 1) + after + 1
        order = np.argsort(key)
        live, key = live[order], key[order]
        own, at = rank[live], np.arange(len(live))
        first = np.concatenate([[True], own[1:] != own[:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.maximum.accumulate(np.where(first, at, 0))
        rank[live] = own + np.maximum.accumulate(np.where(new, at, 0)) - start
        depth *= 2
    return rank


def _first_ranks(key: np.ndarray) -> np.ndarray:
    """Per entry the number of entries with a smaller key."""
    order = np.argsort(key)
    new = np.zeros(len(order), bool)
    new[1:] = np.diff(key[order]) != 0
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return rank


def _common(part: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes the strings at a and b share, at most `most`; part: eights() of the bytes."""
    out, live, at = np.zeros(len(a), np.int64), np.flatnonzero(most > 0), 0
    while len(live):
        differ = part[a[live] + at] ^ part[b[live] + at]
        low = differ & (~differ + U64(1))  # the lowest bit set tells the first byte that differs
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, U64(1)).astype(float)).astype(np.int64) // 8)
        out[live] = np.minimum(at + same, most[live])
        at += 8
        live = live[(same == 8) & (most[live] > at)]
    return out


class _Least:
    """Least values of ranges of an array, from a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.table, width = [values], 1
        while 2 * width <= len(values):
            x = self.table[-1]
            self.table.append(np.minimum(x[:-width], x[width:]))
            width *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of values[a:b] for each pair; no range is empty."""
        level, out = np.log2((b - a).astype(float)).astype(np.int64), np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            x = np.flatnonzero(level == k)
            out[x] = np.minimum(self.table[k][a[x]], self.table[k][b[x] - (1 << k)])
        return out


def repeated_starts(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Per byte whether a string of `size` bytes starts there, inside its text, that starts at another byte too.

    Prefix-free parsing: triggers cut the texts to phrases that overlap by a trigger. The suffixes of the distinct
    phrases are ranked (dictionary), and so are the suffixes of the sequence of phrases (parse). A suffix of the texts
    is ranked by its phrase's suffix, then by the parse from the next phrase on, as no phrase suffix longer than a
    trigger is the beginning of another. In that order equal strings are neighbours; what neighbours share is the rest
    of their phrase and the least that lies between the two places of the parse.
    """
    out, begins, ends = np.zeros(len(data), bool), offsets[:-1], offsets[1:]
    begins = begins[ends > offsets[:-1]]
    if not len(begins):
        return out
    start = np.union1d(begins, triggers(data, offsets))
    text_end = ends[np.searchsorted(ends, start, "right")]
    last = np.concatenate([start[1:] >= text_end[:-1], [True]])
    end = np.where(last, text_end, np.concatenate([start[1:], [0]]) + TRIGGER)
    raw, known = data.tobytes(), {}
    phrase = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    # the dictionary: its phrases end to end
    words = np.frombuffer(b"".join(known), np.uint8)
    lengths = np.array([len(x) for x in known], np.int64)
    place = np.concatenate([[0], np.cumsum(lengths)])
    rest = np.repeat(place[1:], lengths) - np.arange(len(words))
    few = np.minimum(rest, 7)  # the first seven bytes, then how many there are
    cut = (U64(8) - few.astype(U64)) * U64(8)
    first = eights(words)[:-1].byteswap() >> cut << cut | few.astype(U64)
    suffix = suffix_ranks(_first_ranks(first), rest, 7, min(size, int(lengths.max())))
    # the parse: the rank of each phrase, and of what follows
    parse = suffix[place[:-1]][phrase]
    left = np.searchsorted(start, text_end) - np.arange(len(start))
    parse = suffix_ranks(_first_ranks(parse), left, 1, size)
    order, part = np.argsort(parse, kind="stable"), eights(data)
    shared = np.zeros(len(order), np.int64)  # of each place in the parse's order and the one before
    a, b = start[order[:-1]], start[order[1:]]
    shared[1:] = _common(part, a, b, np.minimum(size, np.minimum(text_end[order[:-1]] - a, text_end[order[1:]] - b)))
    least = _Least(shared)
    # corpus order of the places where a whole string starts
    at = np.flatnonzero(np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data)) >= size)
    k = np.searchsorted(start, at, "right") - 1
    by_phrase = suffix[place[phrase[k]] + at - start[k]]
    follows = np.where(last[k], 0, parse[np.minimum(k + 1, len(start) - 1)])
    order = np.argsort(by_phrase * (len(start) + 1) + follows)
    at, k, by_phrase, follows = at[order], k[order], by_phrase[order], follows[order]
    same = by_phrase[1:] == by_phrase[:-1]
    within = np.minimum(end[k[1:]] - at[1:], end[k[:-1]] - at[:-1]) >= size  # ranks compare no more than size bytes
    equal = same & (within | (follows[1:] == follows[:-1]))
    x = np.flatnonzero(same & ~equal)
    if len(x):
        equal[x] = start[k[x] + 1] - at[x] + least.of(follows[x] + 1, follows[x + 1] + 1) >= size
    x = np.flatnonzero(~same & within)
    if len(x):  # inside long phrases
        equal[x] = _common(part, at[x], at[x + 1], np.full(len(x), size)) >= size
    out[at[:-1][equal]] = True
    out[at[1:][equal]] = True
    return out


def _dictionary(size: int, bits: int, owners: int):
    """To each owner: the phrases of a bucket, and those that occur in it more than once."""

    def dictionary(table: pa.Table) -> pa.Table:
        texts, found = whole(table), [np.zeros(0, U64)]
        for _, _, data, offsets in chunks(texts.column("text")):
            a, b, h = _phrases(data, offsets)
            found.append(h[b - a <= size] >> U64(64 - bits))
        values, count = np.unique(np.concatenate(found), return_counts=True)
        runs = spans(values, bits, owners)
        sent = [golomb.encode(values[a:b]) for _, a, b in runs]
        several = [golomb.encode(values[a:b][count[a:b] > 1]) for _, a, b in runs]
        bucket = [table.column("bucket")[0].as_py()] * len(runs)
        return pa.table({"owner": pa.array([o for o, _, _ in runs], pa.int32()), "bucket": pa.array(bucket, pa.int32()), "sent": pa.array(sent, pa.binary()), "several": pa.array(several, pa.binary())})

    return dictionary


def _repeated(table: pa.Table) -> pa.Table:
    """Of each list, the values that occur more than once anywhere."""
    sent = lists(table.column("sent"))
    values, count = np.unique(np.concatenate(sent), return_counts=True)
    twice = np.unique(np.concatenate([values[count > 1], *lists(table.column("several"))]))
    return pa.table({"bucket": table.column("bucket"), "owner": table.column("owner"), "found": pa.array([golomb.encode(x[member(x, twice)]) for x in sent], pa.binary())})


def _candidates(n: int, offsets: np.ndarray, size: int, a: np.ndarray, b: np.ndarray, once: np.ndarray) -> np.ndarray:
    """Starts of the strings inside one text that hold no phrase which occurs once: only those can repeat."""
    if n < size:
        return np.zeros(0, np.int64)
    out = np.zeros(n + 1, np.int64)  # strings that start in [b - size, a] hold the phrase [a, b)
    np.add.at(out, np.maximum(b[once] - size, 0), 1)
    np.add.at(out, a[once] + 1, -1)
    ok = np.cumsum(out)[: n - size + 1] == 0
    for end in offsets[1:-1].tolist():  # strings over a text's end
        ok[max(0, end - size + 1) : end] = False
    return np.flatnonzero(ok)


def _routes(data: np.ndarray, size: int, p: np.ndarray, a: np.ndarray, b: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each string, the least hash of a phrase in it, and the first place of that phrase.

    Equal strings have equal phrases, so they have the same route. Where no phrase lies whole in a string, it is eight of its bytes.
    """
    key, place = np.empty(len(p), U64), np.empty(len(p), np.int64)
    lo, hi = np.searchsorted(a, p), np.searchsorted(b, p + size, "right")
    level = np.log2(np.maximum(hi - lo, 1).astype(float)).astype(np.int64)
    table, width = np.arange(len(a)), 1
    for k in range(int(level.max(initial=0)) + 1):
        x = np.flatnonzero((level == k) & (hi > lo))
        if len(x):
            u, v = table[lo[x]], table[hi[x] - width]
            best = np.where(h[u] <= h[v], u, v)
            key[x], place[x] = h[best], a[best]
        u, v = table[:-width], table[width:]
        table, width = np.where(h[u] <= h[v], u, v), 2 * width
    bare = np.flatnonzero(hi <= lo)
    if len(bare):
        grams = mix(eights(data)[: len(data) - TRIGGER + 1] ^ U64(0x5851F42D4C957F2D))
        for x in np.split(bare, np.flatnonzero(np.diff(p[bare]) > 1) + 1):
            for y in np.split(x, range(4096, len(x), 4096)):
                own = grams[p[y[0]] : p[y[-1]] + size - TRIGGER + 1]
                place[y] = p[y] + np.lib.stride_tricks.sliding_window_view(own, size - TRIGGER + 1).argmin(1) if size > TRIGGER else p[y]
                key[y] = grams[place[y]] if size >= TRIGGER else U64(0)
    return key, place


def _stretches(size: int, bits: int):
    """The stretches of a bucket whose strings have one route, each content once with all its places.

    inner: that route's phrase is at several places, so strings of one stretch may be equal."""

    def stretches(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, repeated, found = whole(table), joined(answers.column("found")), {}
        for row, _, data, offsets in chunks(texts.column("text")):
            a, b, h = _phrases(data, offsets)
            once = (b - a <= size) & ~member(h >> U64(64 - bits), repeated)
            p = _candidates(len(data), offsets, size, a, b, once)
            if not len(p):
                continue
            key, place = _routes(data, size, p, a, b, h)
            key = mix(key + ((place - p) // STEP).astype(U64))
            new = np.concatenate([[True], (np.diff(p) > 1) | (key[1:] != key[:-1])])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(p)) - 1
            first, last, inner = p[head], p[tail], place[tail] != place[head]
            text = np.searchsorted(offsets, first, "right") - 1
            own = zip(key[head].tolist(), inner.tolist(), first.tolist(), (last + size).tolist(), (text + row).tolist(), (first - offsets[text]).tolist(), strict=True)
            raw = data.tobytes()
            for route, several, x, y, at, begin in own:
                found.setdefault(raw[x:y], [route, several]).extend((at, begin))
        route = np.array([x[0] for x in found.values()], U64)
        places = [np.array(x[2:], np.int64).tobytes() for x in found.values()]
        inner = pa.array([x[1] for x in found.values()], pa.bool_())
        names = [hashlib.blake2b(x, digest_size=16).digest() for x in found]
        bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
        times = pa.array([len(x) // 16 for x in places], pa.int64())
        return pa.table({"bucket": pa.array([bucket] * len(found), pa.int32()), "name": pa.array(names, pa.binary()), "route": route.view(np.int64), "inner": inner, "times": times, "places": pa.array(places, pa.binary()), "content": pa.array(list(found), pa.binary())})

    return stretches


def _ordered(size: int):
    """Of each stretch, which of its strings start elsewhere too: bits, in the order of the strings. No two rows are equal."""

    def ordered(table: pa.Table) -> pa.Table:
        contents, times = table.column("content").to_pylist(), table.column("times").to_numpy()
        route, inner = table.column("route").to_numpy(), table.column("inner").to_numpy(zero_copy_only=False)
        bits = [np.full(len(x) - size + 1, n > 1) for x, n in zip(contents, times.tolist(), strict=True)]
        order = np.argsort(route, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(route[order])) + 1)
        some, total = [], 0
        for k, g in enumerate(groups):
            if (times[g] == 1).any() and (len(g) > 1 or inner[g[0]]):
                some += g.tolist()
                total += sum(len(contents[j]) for j in g)
            if some and (total > PART or k == len(groups) - 1):
                offsets = np.cumsum([0, *(len(contents[j]) for j in some)])
                found = repeated_starts(np.frombuffer(b"".join([contents[j] for j in some]), np.uint8), offsets, size)
                for j, x, y in zip(some, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    bits[j] |= found[x : y - size + 1]
                some, total = [], 0
        packed = [np.packbits(x).tobytes() if x.any() else None for x in bits]
        out = pa.table({"name": table.column("name"), "found": pa.array(packed, pa.binary())})
        return out.filter(out.column("found").is_valid())

    return ordered


def _remove(size: int, with_text: bool):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = whole(table)
        many, column = texts.column("many").to_pylist(), texts.column("text")
        lengths = np.array([len(memoryview(x.as_buffer())) for x in column], np.int64)
        base = np.concatenate([[0], np.cumsum(lengths)])
        starts = [np.zeros(0, np.int64)]
        for places, found in zip(answers.column("places"), answers.column("found"), strict=True):
            at = np.frombuffer(places.as_py(), np.int64).reshape(-1, 2)
            own = np.flatnonzero(np.unpackbits(np.frombuffer(found.as_py(), np.uint8)))
            starts.append((base[at[:, :1]] + at[:, 1:] + own).ravel())
        starts = np.concatenate(starts)
        cover = np.zeros(base[-1] + 1, np.int32)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + size, -1)
        covered = np.cumsum(cover, dtype=np.int32)[:-1] > 0
        out = {"sha": texts.column("sha").to_pylist(), "n_bytes": lengths.tolist(), "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for k, text in enumerate(column):
            x, y = int(base[k]), int(base[k + 1])
            text, own = text.as_py(), covered[x:y]
            if many[k] and y - x >= size:
                own = np.ones(y - x, bool)
            n = int(own.sum())
            kept = np.frombuffer(text, np.uint8)[~own].tobytes() if n else text
            out["n_removed"].append(n)
            out["n_spans"].append(int((np.diff(own.astype(np.int8), prepend=0) == 1).sum()) if n else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept if with_text else None)
        return pa.table(out, schema=pa.schema([("sha", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]))

    return remove


def suffix_dedup(docs: DataFrame, size: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and (with_text) kept, the bytes that stay.

    A text is its UTF-8 bytes (null: none). Every byte is removed that lies in a string of `size` (8 or more) bytes
    which also starts anywhere else, in the same document too; strings never cross documents, and all are judged on
    the input. Repeated rows are documents of their own, so equal texts of size bytes or more lose everything; ids,
    null ones too, are only passed on; an empty table gives an empty result; other columns are not looked at.

    Rolling-hash triggers cut each text into phrases that overlap by a trigger (prefix-free parsing). The dictionary
    is counted over the corpus first; a string that holds a phrase which occurs once cannot repeat, so only the
    repetitive stretches of the parse go on. Their strings are dealt by a phrase that each of them holds, runs of
    them as one stretch, to owners; equal stretches, told by 128-bit hashes, are one before that, so a passage of any
    number of documents is one row. Each owner ranks the suffixes of its dictionary and of its parse, which gives the
    order of all suffixes of its stretches; neighbours that share `size` bytes, byte for byte, are repeats.
    """
    if size < TRIGGER:
        raise ValueError(f"size is {TRIGGER} at least")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = Buckets(docs, id_col, text_col, BUCKET)
    bits = min(64, max(32, texts.n_bytes.bit_length() + 6))  # a false repeat of a phrase costs a comparison, no more
    owners, orders = shards(docs.sparkSession, texts.n_bytes / 4, PER_OWNER), shards(docs.sparkSession, texts.n_bytes, STRETCHES)
    groups = texts.texts.groupBy("bucket")
    phrases = groups.applyInArrow(_dictionary(size, bits, owners), "owner int, bucket int, sent binary, several binary").groupBy("owner").applyInArrow(_repeated, "bucket int, owner int, found binary")
    stretches = groups.cogroup(phrases.groupBy("bucket")).applyInArrow(_stretches(size, bits), "bucket int, name binary, route long, inner boolean, times long, places binary, content binary")
    stretches = durable(stretches, "stretches")
    contents = stretches.groupBy("name").agg(F.first("route").alias("route"), F.first("inner").alias("inner"), F.sum("times").alias("times"), F.first("content").alias("content"))
    ordered = contents.withColumn("owner", F.pmod(F.xxhash64("route"), F.lit(orders))).groupBy("owner").applyInArrow(_ordered(size), "name binary, found binary")
    repeats = stretches.select("bucket", "name", "places").join(ordered, "name").select("bucket", "places", "found")
    found = groups.cogroup(repeats.groupBy("bucket")).applyInArrow(_remove(size, with_text), "sha binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = texts.spread(found)
    columns = [F.when(F.col("id") > -(2**63), F.col("id")).cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return out.select(*columns, *(["kept"] if with_text else []))
