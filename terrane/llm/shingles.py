"""Word shingles of a text as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words remembered with their hash, a matter of speed only.
WORDS_KEPT = 300_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_known: dict[bytes, int] = {}


def _hash(word: bytes) -> int:
    h = _known.get(word)
    if h is None:
        if len(_known) > WORDS_KEPT:
            _known.clear()
        h = _known[word] = xxhash.xxh64_intdigest(word)
    return h


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct shingles of ``width`` words, A to Z lower-cased, words parted by blanks and control white space.

    Fewer words make one shingle of the whole sequence; no words, none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash, words), np.uint64, len(words))
    width = min(width, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        total = mixed(total + h[i : len(h) - width + 1 + i] * _ODD[i % 3])
    return np.unique(total)


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signature(shingles: np.ndarray, coords: int) -> np.ndarray:
    """Minimum over the set under each of ``coords`` hash functions, as signed numbers."""
    seeds = mixed(np.arange(1, coords + 1, dtype=np.uint64) * _ODD[0])
    out = np.empty(coords, np.uint64)
    for at in range(0, coords, 8):
        values = (shingles[None, :] ^ seeds[at : at + 8, None]) * _ODD[1]
        values ^= values >> np.uint64(32)
        out[at : at + 8] = (values * _ODD[0]).min(1)
    return out.view(np.int64)


def bins(shingles: np.ndarray) -> bytes:
    """A byte for each of 256 parts of the hash range: its smallest shingle, or 0 if it is empty."""
    out = np.zeros(256, np.uint8)
    if len(shingles):
        part = (shingles >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out[part[first]] = 1 + mixed(shingles[first] ^ _ODD[1]) % np.uint64(255)
    return out.tobytes()
