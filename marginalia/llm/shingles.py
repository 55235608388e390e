"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words are runs of anything but white space, after lower-casing A-Z.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Words to 64-bit hashes, computed once per word while they are kept."""

    MOST = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def forget() -> None:
    """Give the memory of the words' hashes back, at the end of a task."""
    _WORDS.clear()


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes | None, k: int = 5) -> np.ndarray:
    """The distinct ``k``-word shingles; of fewer words the whole sequence; empty without any."""
    # bytes.split strips exactly space and \\t-\\r
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(k, len(w))
    n = len(w) - size + 1
    with np.errstate(over="ignore"):
        h = w[:n].copy()
        for i in range(1, size):
            h *= _MULT
            h += w[i : n + i]
        h += np.uint64(size)
    h = mix(h)
    h.sort()
    keep = np.empty(n, bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
