"""Static three-way binary fuse filters with 8-bit fingerprints, built and asked in whole arrays."""

from __future__ import annotations

import math
import struct

import numpy as np

_HEAD = struct.Struct("<QIIII")


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(seed)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of 2) and number of segments a key may start in."""
    length = 1 << max(2, min(18, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    count = max(1, math.ceil(n * factor / length) - 2)
    return length, count


def _places(h: np.ndarray, length: int, count: int) -> np.ndarray:
    high = ((h >> np.uint64(32)) * np.uint64(count * length) >> np.uint64(32)).astype(np.int64)
    mask = length - 1
    h0 = high
    h1 = (high + length) ^ ((h >> np.uint64(18)).astype(np.int64) & mask)
    h2 = (high + 2 * length) ^ (h.astype(np.int64) & mask)
    return np.stack([h0, h1, h2])


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ h >> np.uint64(32)) & np.uint64(255)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter of 64-bit keys as bytes; repeated keys count once. Peeling failures try the next seed."""
    keys = np.unique(np.asarray(keys).astype(np.uint64))
    n = len(keys)
    length, count = _shape(n)
    size = (count + 2) * length
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        at = _places(h, length, count)
        degree = np.bincount(at.ravel(), minlength=size)
        which = np.zeros(size, np.int64)
        np.bitwise_xor.at(which, at.ravel(), np.tile(np.arange(n), 3))
        peeled: list[tuple[np.ndarray, np.ndarray]] = []
        free = np.flatnonzero(degree == 1)
        left = n
        while len(free):
            key, first = np.unique(which[free], return_index=True)
            peeled.append((key, free[first]))
            left -= len(key)
            touched = at[:, key].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(which, touched, np.tile(key, 3))
            touched = np.unique(touched)
            free = touched[degree[touched] == 1]
        if left:
            continue
        table, prints = np.zeros(size, np.uint8), _prints(h)
        for key, place in reversed(peeled):
            p = at[:, key]
            table[place] = prints[key] ^ table[p[0]] ^ table[p[1]] ^ table[p[2]] ^ table[place]
        return _HEAD.pack(seed, length, count, n, 0) + table.tobytes()
    raise RuntimeError("no seed gave a filter")


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key of the filter, and for about one in 256 others. An empty filter holds nothing."""
    seed, length, count, n, _ = _HEAD.unpack_from(blob)
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint8, offset=_HEAD.size)
    h = _mix(np.asarray(keys).astype(np.uint64), seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    p = _places(h, length, count)
    return (table[p[0]] ^ table[p[1]] ^ table[p[2]]) == _prints(h)
