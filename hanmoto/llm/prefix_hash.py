"""Prefix polynomial hashes over bytes: one modular prefix array answers the equality of any two spans.

Two polynomials with random bases and random byte values, both modulo the prime 2^31 - 1, make 62 bits. A span's hash does not
depend on where it lies, so hashes of different arrays compare too.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PRIME = (1 << 31) - 1
_P = np.uint64(PRIME)
_31 = np.uint64(31)
_random = np.random.default_rng(20240501)
BASES = [int(x) for x in _random.integers(1 << 20, PRIME - 1, 2)]
VALUES = [_random.integers(1, PRIME, 256).astype(np.uint64) for _ in BASES]


def reduce(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2^62."""
    for _ in range(2):
        high = x >> _31
        x = x & _P
        x += high
    return np.minimum(x, x - _P)  # what is below the prime wraps around


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, log: int) -> np.ndarray:
    """The first 2^log powers at least: one table a base, which grows with the longest text."""
    out = _tables.get(base, np.ones(1, np.uint64))
    while len(out) < 1 << log:
        out = np.concatenate([out, reduce(out * np.uint64(pow(base, len(out), PRIME)))])
        _tables[base] = out
    return out


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    base = BASES[which]
    return _powers(pow(base, -1, PRIME) if inverse else base, max(10, (max(n, 1) - 1).bit_length()))[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A random-looking order of hashes (a bijection of 64-bit numbers)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class PrefixHash:
    def __init__(self, data: np.ndarray):
        self.data, n = data, len(data)
        self.sums = []
        for r in range(2):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(reduce(VALUES[r][data] * powers(r, n)), out=sums[1:])
            self.sums.append(reduce(sums))

    def span(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hashes of many spans."""
        h = [reduce((s[start + length] + _P - s[start]) * powers(r, len(s), True)[start]) for r, s in enumerate(self.sums)]
        return h[0] << _31 | h[1]

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all spans of length k, by start."""
        n = len(self.data) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        h = [reduce((s[k:] + _P - s[:n]) * powers(r, n, True)) for r, s in enumerate(self.sums)]
        return h[0] << _31 | h[1]

    def common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Lengths of the longest common extensions of the spans from a and from b, up to ``limit``, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.array(limit, np.int64)
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = self.span(a, mid) == self.span(b, mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low


_WRAP_BASE = 0x5851F42D4C957F2D
_WRAP_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=8)
def _wrap_powers(base: int, log: int) -> np.ndarray:
    out = np.ones(1 << log, np.uint64)
    for k in range(log):
        n = 1 << k
        out[n : 2 * n] = out[:n] * np.uint64(pow(base, n, 1 << 64))
    return out


def wrap_hash(rows: np.ndarray) -> np.ndarray:
    """The hash of each row of bytes, as ``WrapHash.span`` gives it."""
    n = rows.shape[1]
    return (_WRAP_VALUES[rows] * _wrap_powers(_WRAP_BASE, max(10, n.bit_length()))[:n]).sum(1, dtype=np.uint64)


class WrapHash:
    """Prefix hashes modulo 2^64, a quarter of the work: for short spans whose equality is verified byte by byte afterwards."""

    def __init__(self, data: np.ndarray):
        log = max(10, len(data).bit_length())
        self.inverse = _wrap_powers(pow(_WRAP_BASE, -1, 1 << 64), log)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_WRAP_VALUES[data] * _wrap_powers(_WRAP_BASE, log)[: len(data)], out=self.sums[1:])

    def span(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """As ``PrefixHash.common``, with one limit."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
        from_a, from_b, by_a, by_b = self.sums[a], self.sums[b], self.inverse[a], self.inverse[b]
        for _ in range(limit.bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.sums[a + mid] - from_a) * by_a == (self.sums[b + mid] - from_b) * by_b
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low
