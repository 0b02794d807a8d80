"""Golomb-Rice coding of sorted 64-bit numbers, vectorised."""

from __future__ import annotations

import struct

import numpy as np

U64 = np.uint64


def encode(values: np.ndarray) -> bytes:
    """Sorted uint64 values as head, unary quotients and fixed-width remainders of the gaps."""
    n = len(values)
    if not n:
        return struct.pack("<QBQ", 0, 0, 0)
    gaps = np.diff(values, prepend=values[:1])
    k = max(0, (int(values[-1] - values[0]) // n).bit_length() - 1)
    quotients = (gaps >> U64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=U64)) & U64(1)).astype(np.uint8)
    head = np.packbits(unary).tobytes()
    return struct.pack("<QBQ", n, k, int(values[0])) + struct.pack("<Q", len(head)) + head + np.packbits(rest).tobytes()


def decode(blob: bytes) -> np.ndarray:
    n, k, first = struct.unpack_from("<QBQ", blob)
    if not n:
        return np.zeros(0, U64)
    (size,) = struct.unpack_from("<Q", blob, 17)
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, size, 25))
    gaps = (np.diff(np.flatnonzero(unary)[:n], prepend=-1) - 1).astype(U64) << U64(k)
    rest = np.unpackbits(np.frombuffer(blob, np.uint8, -1, 25 + size), count=n * k).reshape(n, k) if k else np.zeros((n, 0), np.uint8)
    for j in range(k):
        gaps |= rest[:, j].astype(U64) << U64(j)
    gaps[0] = U64(first)
    return np.cumsum(gaps, dtype=U64)
