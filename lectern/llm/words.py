"""Words and word shingles, hashed alike on every executor."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """The lower-cased runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    """Word -> 64-bit hash, forgotten when it holds too many words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def word_hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (64-bit murmur)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n words (wrapping 64-bit arithmetic)."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * STEP + ids[k : len(ids) - n + 1 + k]
    return out


def shingles(tokens: list[str], n: int = 5) -> np.ndarray:
    """The sorted set of hashes of runs of n words; a shorter text is one run."""
    ids = word_hashes(tokens)
    return np.unique(mixed(windows(ids, min(n, len(ids)) or 1)))
