"""Cuckoo filter over 64-bit key hashes, with whole arrays as its unit of work."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """``SLOTS`` fingerprints of 16 bits in each bucket; 0 marks a free slot.

    A key has two buckets, either one found from the other and the
    fingerprint, so that a key can be moved, and deleted, without its hash.
    Each key must be inserted once only; ``delete`` removes one copy.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """Room for ``keys`` keys at a load of three quarters at most."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.75)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter that holds ``keys``; one that does not settle starts again with twice the room."""
        out = cls.sized(len(keys))
        while not out.insert(keys):
            out = cls(np.zeros((2 * len(out.table), SLOTS), np.uint16))
        return out

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def __len__(self) -> int:
        return int((self.table > 0).sum())

    def _at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = keys.astype(np.uint64) * _MIX
        mixed ^= mixed >> np.uint64(32)
        prints = ((mixed & np.uint64(0xFFFF)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        return ((mixed >> np.uint64(16)) & np.uint64(len(self.table) - 1)).astype(np.int64), prints

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key inserted, and for a few others."""
        if len(keys) == 0:
            return np.zeros(0, bool)
        first, prints = self._at(keys)
        here = (self.table[first] == prints[:, None]).any(1)
        return here | (self.table[self._other(first, prints)] == prints[:, None]).any(1)

    def insert(self, keys: np.ndarray, rounds: int = 500) -> bool:
        """Insert all keys, or return False (the filter is then to be built anew, larger)."""
        bucket, prints = self._at(keys)
        rng = np.random.default_rng(len(keys))
        for turn in range(rounds):
            if len(bucket) == 0:
                return True
            order = np.argsort(bucket, kind="stable")
            bucket, prints = bucket[order], prints[order]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rank = np.arange(len(bucket)) - np.repeat(starts, np.diff(np.r_[starts, len(bucket)]))
            free = self.table[bucket] == 0
            placed = rank < free.sum(1)
            # The slot of the rank-th free place of the bucket.
            slot = np.argmax(np.cumsum(free, 1) == rank[:, None] + 1, axis=1)
            self.table[bucket[placed], slot[placed]] = prints[placed]
            bucket, prints = bucket[~placed], prints[~placed]
            if turn and len(bucket):
                # One newcomer a bucket takes a random place; who sat there moves to its other bucket.
                lead = np.r_[True, bucket[1:] != bucket[:-1]]
                at, seat = bucket[lead], rng.integers(0, SLOTS, int(lead.sum()))
                out = self.table[at, seat].copy()
                self.table[at, seat] = prints[lead]
                prints[lead] = out
                bucket[lead] = self._other(at, out)
                bucket[~lead] = self._other(bucket[~lead], prints[~lead])
            else:
                bucket = self._other(bucket, prints)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out one fingerprint for each key; the keys must have been inserted."""
        bucket, prints = self._at(keys)
        for _ in range(2):
            if len(bucket) == 0:
                return
            order = np.lexsort((prints, bucket))
            b, p = bucket[order], prints[order]
            same = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (p[1:] != p[:-1])])
            rank = np.arange(len(b)) - np.repeat(same, np.diff(np.r_[same, len(b)]))
            match = self.table[b] == p[:, None]
            found = rank < match.sum(1)
            slot = np.argmax(np.cumsum(match, 1) == rank[:, None] + 1, axis=1)
            self.table[b[found], slot[found]] = 0
            bucket, prints = self._other(b[~found], p[~found]), p[~found]
