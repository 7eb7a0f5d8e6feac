"""Suffix sort by prefix hashes: a mergesort whose comparisons find common extensions by binary search.

Suffixes of many groups are sorted together. A comparison of two suffixes takes a binary search
over the length of their common prefix, with prefix polynomial hashes in place of characters, then
looks at the next byte. All merges of one width are done at once.
"""

from __future__ import annotations

import numpy as np

from .polyhash import PrefixHash


def common_extension(hashes: PrefixHash, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """For each pair of starts, how many of the next ``length`` bytes agree."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length, np.int64)
    while len(a) and (low < high).any():
        middle = (low + high + 1) // 2
        same = hashes.of(a, a + middle) == hashes.of(b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def before(data: np.ndarray, hashes: PrefixHash, a: np.ndarray, b: np.ndarray, length: int, or_equal: bool) -> np.ndarray:
    """Whether suffix a stands before suffix b (or equals it)."""
    n = common_extension(hashes, a, b, length)
    split = n < length
    n = np.minimum(n, length - 1)
    return np.where(split, data[a + n] < data[b + n], or_equal)


def sort_suffixes(data: np.ndarray, hashes: PrefixHash, starts: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """An order of the suffixes: by group (given in ascending order), then by the first ``length`` bytes."""
    n = len(starts)
    order = np.arange(n)
    first = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, n))
    base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    inside = np.arange(n) - base
    width = 1
    while n and width < sizes.max():
        block = inside // (2 * width) * (2 * width)
        middle, end = np.minimum(block + width, size), np.minimum(block + 2 * width, size)
        left = inside < middle
        # rank of each element among the other half: a left one passes those before it, a right one also its equals
        low, high = np.where(left, middle, block), np.where(left, end, middle)
        other = low.copy()
        going = low < high
        while going.any():
            k = np.flatnonzero(going)
            half = (low[k] + high[k]) // 2
            theirs, own = starts[order[base[k] + half]], starts[order[k]]
            passed = np.empty(len(k), bool)
            for side in (True, False):
                m = left[k] == side
                passed[m] = before(data, hashes, theirs[m], own[m], length, not side)
            low[k], high[k] = np.where(passed, half + 1, low[k]), np.where(passed, high[k], half)
            going = low < high
        to = base + np.where(left, inside + low - other, block + (inside - middle) + low - other)
        moved = np.empty_like(order)
        moved[to] = order
        order, width = moved, 2 * width
    return order


def repeated(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """For each suffix, whether another of its group with another owner has the same first ``length`` bytes.

    Neighbours in suffix order that agree by hash are compared byte for byte.
    """
    hashes = PrefixHash(data)
    order = sort_suffixes(data, hashes, starts, groups, length)
    a, b = starts[order[:-1]], starts[order[1:]]
    same = (groups[order[:-1]] == groups[order[1:]]) & (common_extension(hashes, a, b, length) == length)
    reach = np.arange(length)
    for part in np.array_split(np.flatnonzero(same), max(1, len(same) // 4096)):
        same[part] = (data[a[part, None] + reach] == data[b[part, None] + reach]).all(axis=1)
    family = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    ids = owners[order]
    least = np.full(len(order), np.iinfo(np.int64).max)
    most = np.full(len(order), np.iinfo(np.int64).min)
    np.minimum.at(least, family, ids)
    np.maximum.at(most, family, ids)
    out = np.zeros(len(order), bool)
    out[order] = (least < most)[family]
    return out
