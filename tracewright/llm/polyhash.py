"""Prefix polynomial hashes over a batch of byte strings, as flat numpy arrays.

With prefix sums P[i] = sum(T[byte j] * B^j, j < i) modulo 2^64 and an odd base B, the hash of
any substring is (P[end] - P[start]) * B^-start: two subtractions and a product, for as many
substrings at once as an array holds.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the high bits over all others."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0xBF58476D1CE4E5B9))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i for i < n."""
    while len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            have = _powers[k]
            _powers[k] = np.concatenate([have, have * _U(pow(base, len(have), 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


class PrefixHash:
    """Hashes of substrings of one flat uint8 array."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(BYTE_VALUES[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hash of data[start:end]; equal strings have equal values wherever they stand."""
        return (self.sums[end] - self.sums[start]) * self.down[start]


def chunks(sizes, limit: int = 1 << 18):
    """Ranges (i, j) of consecutive items whose sizes sum to at most limit, or hold one item."""
    i, total = 0, 0
    for j, n in enumerate(sizes):
        if j > i and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)
