"""Word shingles of texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import segments

#: A-Z to a-z, nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes(dict):
    """Word (bytes) -> its 64-bit hash; emptied when it grows large, so its size is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str | None, cache: WordHashes) -> np.ndarray:
    """Hashes of the words of a text in order: A-Z lowered, words between the blanks 0x20 and 0x09-0x0D."""
    out = []
    for part in segments(text or ""):
        words = part.encode("utf-8", "surrogatepass").translate(LOWER).split()
        out.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, cache: WordHashes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct ``size``-word shingles; of a shorter text, one hash of the whole sequence; of a
    text without words, none."""
    w = word_hashes(text, cache)
    if not len(w):
        return w
    k = min(size, len(w))
    h = w[: len(w) - k + 1] + np.uint64(k)
    for i in range(1, k):
        h = mixed(h) + w[i : len(w) - k + 1 + i]
    return np.unique(mixed(h))
