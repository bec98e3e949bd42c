"""Sets of word shingles as 64-bit hashes, and exact Jaccard tests on them."""

from __future__ import annotations

import numpy as np
import xxhash

CACHED_WORDS = 400_000
#: Odd multipliers, one per place in a shingle; the last one takes the number of words.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                   0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _WordHashes()


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64 bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a UTF-8 text, A-Z in lower case.

    Words are runs of anything but ASCII white space. Fewer than ``size`` words make one shingle of
    them all; without words the set is empty.
    """
    found = (text or b"").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_hashes.__getitem__, found), np.uint64, n)
    width = min(n, size)
    sums = hashes[: n - width + 1] * PLACES[0]
    for place in range(1, width):
        sums += hashes[place : n - width + 1 + place] * PLACES[place]
    return np.unique(mix(sums + PLACES[-1] * np.uint64(width)))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Is the intersection at least ``percent`` per cent of the union? Never for empty sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)
