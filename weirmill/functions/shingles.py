"""Hashed words and word shingles of whole texts, vectorised within a text."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_KEEP = 500_000
_WORDS = re.compile(r"[^\W_]+")


class _WordHash(dict):
    """Word to 64-bit hash; forgets all words when it grows beyond a fixed size."""

    def __missing__(self, word: str) -> int:
        if len(self) > _KEEP:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASH = _WordHash()


def plain_words(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORDS.findall(text.lower())


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((_HASH[w] for w in words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k``; none of a shorter text."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    got = np.zeros(n, np.uint64)
    for i in range(k):
        got = (got ^ hashes[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        got ^= got >> np.uint64(29)
    return got
