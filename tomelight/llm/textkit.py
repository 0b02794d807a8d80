"""Vectorised word splitting and hashing over Arrow string columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Spans of more bytes than this are hashed one by one by xxh3, shorter ones eight bytes at a time together.
_LONG = 256
_ODD = U64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes of pairs."""
    return mix(x * _ODD + y)


def eights(data: np.ndarray) -> np.ndarray:
    """At each byte, it and the seven after it as one number; past the end come zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def byte_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans data[a:b]: a chain of finalised eight-byte steps, with no algebra that texts could break."""
    import xxhash

    n = b - a
    out = mix(n.astype(U64) * _ODD)
    raw = memoryview(np.ascontiguousarray(data))
    for k in np.flatnonzero(n > _LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[int(a[k]) : int(b[k])])
    part, live = eights(data), np.flatnonzero((n > 0) & (n <= _LONG))
    at, left, h = a[live], n[live], out[live]
    while len(live):
        h = mix((h * _ODD) ^ (part[at] & _MASKS[np.minimum(left, 8)]))
        out[live] = h
        more = left > 8
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    return out


def give_back() -> None:
    """Return memory that is free to the system at a task's end: the process lives on for other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def as_binary(column) -> pa.Array:
    """A string column as large_binary, null as empty, in one array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    return pc.fill_null(column, "").cast(pa.large_binary())


def chunks(column, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets) of runs of whole texts of about `limit` bytes; a longer text is a run of its own."""
    column = as_binary(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, per text, the number of the first word (one more at the end)."""
    solid = ~_WHITE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = solid
    before[offsets] = False
    after[offsets] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    ends = np.flatnonzero(solid & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n entries (those over a text's end too; the caller leaves them out), by doubling."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    h, have = mix(hashes + U64(n)), 1
    while have < n:
        step = min(have, n - have)
        h, have = combine(h[: len(h) - step], h[step:]), have + step
    return h


def run_hashes(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the runs of entries [a, b), few and short ones."""
    out, left, at = mix((b - a).astype(U64) * _ODD), b - a, a.copy()
    while (left > 0).any():
        live = left > 0
        out[live] = combine(out[live], hashes[at[live]])
        at, left = at + 1, left - 1
    return out


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """For word numbers per text `first`, a mask of the runs of n words that stay in one text."""
    total = int(first[-1])
    ok = np.zeros(max(0, total - n + 1), bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            ok[a : b - n + 1] = True
    return ok


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(s, s + l)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)
