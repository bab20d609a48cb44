"""Shingle sets and one-permutation signatures with optimal densification (NumPy, one text at a time).

A text's words are what white space leaves of it, with A-Z in lower case. Each
distinct word has a 64-bit hash, each run of ``k`` words a mix of theirs; a text
of fewer words is one shingle, one without words an empty set.

One permutation: the hash line is cut into bins and each bin keeps its smallest
hash. An empty bin borrows from the first full bin of its own fixed random
order (optimal densification), so two sets agree in a bin with the probability
of their Jaccard similarity, short texts included.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import worker_cache

#: Words whose hashes a worker remembers at a time.
REMEMBERED = 200_000
_ODD = np.random.default_rng(20240501).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread bits (a 64-bit finalizer)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``k`` words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    known = worker_cache("minhash")
    if len(known) > REMEMBERED:
        known.clear()
    own = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        own.append(h)
    h = np.array(own, np.uint64)
    with np.errstate(over="ignore"):
        if n < k:
            return mix(np.array([(h * _ODD[32 : 32 + n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
        total = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            total += h[i : n - k + 1 + i] * _ODD[i]
        return np.unique(mix(total))


class Signer:
    """Signatures of ``bands * rows`` bins and their band hashes."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(20240502)
        self.order = np.array([rng.permutation(self.bins) for _ in range(self.bins)], np.int32)
        self.weights = rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(1, 1 << 63, bands, dtype=np.uint64)

    def signature(self, s: np.ndarray) -> np.ndarray:
        at = ((s >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # s is sorted, so a bin's first is its least
        sig = np.zeros(self.bins, np.uint64)
        full = np.zeros(self.bins, bool)
        where = at[first].astype(np.int64)
        sig[where], full[where] = s[first], True
        empty = np.flatnonzero(~full)
        if len(empty):
            order = self.order[empty]
            lender = order[np.arange(len(empty)), full[order].argmax(1)]
            sig[empty] = sig[lender]
        return sig

    def band_hashes(self, sig: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((mix(sig).reshape(self.bands, self.rows) * self.weights).sum(1, dtype=np.uint64) ^ self.salt)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, hundredths: int) -> bool:
    """100 * intersection >= hundredths * union, of two sorted sets."""
    n, m = len(a), len(b)
    if not n or not m or 100 * min(n, m) < hundredths * max(n, m):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= hundredths * (n + m - common)
