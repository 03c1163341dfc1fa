"""Word shingles as 64-bit hashes, for the operators on word sequences.

Words are maximal runs of bytes other than space and 09-0D, after lower-casing A-Z only. A shingle is a run
of ``k`` words; a text with fewer words counts as one shingle of all of them; no words, no shingles.
"""

from __future__ import annotations

import numpy as np
import xxhash

K = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MAX_WORDS = 150_000


class _Hashes(dict):
    """Hash of a word, kept in a bounded table."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, 11)
        return h


_hashes = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that equal bits stay as rare as in the input and all bits count."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []  # bytes: ASCII case, ASCII white space


def forget() -> None:
    """Empty the table of word hashes, at a task's end."""
    _hashes.clear()


def word_hashes(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def shingles_of(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Shingle hashes in order of place, with repeats."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(k, n)
    out = np.full(n - size + 1, np.uint64(size), np.uint64)
    for j in range(size):
        out = out * _MIX + hashes[j : n - size + 1 + j]
        out ^= out >> np.uint64(29)
    return mixed(out)


def shingle_set(text: str | None, k: int = K) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingles_of(word_hashes(text), k))
