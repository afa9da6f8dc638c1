"""Five-word shingle sets as sorted 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

WIDTH = 5
MEMORY = 200_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; a Python worker remembers a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            self[word] = found
        return found


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    """One memory for all tasks of a Python worker."""
    return WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the finaliser of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles: A-Z lowered, words
    ``[^\\x20\\x09-\\x0D]+``; fewer words than a shingle are one; none are none."""
    # Of bytes, lower() and split() know ASCII only: exactly A-Z and these six blanks.
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(h))):
        out = out * FACTOR + h[k : k + n]
    out = mixed(out + np.uint64(min(width, len(h))))
    out.sort()
    return out if len(out) < 2 else out[np.concatenate(([True], out[1:] != out[:-1]))]


class Signer:
    """MinHash signatures of ``bands * rows`` 32-bit values."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.add = random.integers(0, 2**63, bands * rows, dtype=np.uint64)[:, None]
        self.times = (random.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        best = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 512):
            best = np.minimum(best, ((shingles[at : at + 512] ^ self.add) * self.times).min(axis=1))
        return (best >> np.uint64(32)).astype(np.uint32)

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; the band's number is part of it."""
        parts = signature.reshape(self.bands, self.rows).astype(np.uint64)
        out = np.arange(1, self.bands + 1, dtype=np.uint64) * FACTOR
        for k in range(self.rows):
            out = mixed(out * FACTOR + parts[:, k])
        return out
