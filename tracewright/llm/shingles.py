"""Word shingles of texts as sorted distinct 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .polyhash import PrefixHash, chunks, mix

WORDS = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """A-Z in lower case, cut at space and the bytes 9 to 13."""
    return text.translate(_LOWER).split()


def normal_form(text: bytes) -> bytes:
    """Words joined by one space: texts of one form have one shingle set."""
    return b" ".join(words_of(text))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its distinct shingles' hashes, sorted; fewer words than ``words`` are one shingle, none give none."""
    forms = [normal_form(t) for t in texts]
    for i, j in chunks([len(f) + 1 for f in forms]):
        own = forms[i:j]
        data = np.frombuffer(b" ".join([*own, b""]), np.uint8)
        hashes = PrefixHash(data)
        at = 0
        spaces = np.flatnonzero(data == 32)
        for form in own:
            if not form:
                at += 1
                yield np.zeros(0, np.uint64)
                continue
            a, b = np.searchsorted(spaces, [at, at + len(form)])
            ends = spaces[a : b + 1]
            starts = np.concatenate([[at], ends[:-1] + 1])
            n = max(1, len(ends) - words + 1)
            yield np.unique(mix(hashes.of(starts[:n], ends[len(ends) - n :]) ^ np.uint64(len(ends) < words)))
            at += len(form) + 1
