"""A cuckoo filter in numpy: 16-bit marks in buckets of four, put in and taken out many at a time."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ROUNDS = 500


class CuckooFilter:
    """A key's mark is in one of two buckets, each known from the other and the mark.  Keys are rows of two uint64."""

    def __init__(self, capacity: int, slots: np.ndarray | None = None) -> None:
        n = 1 << max(1, int(np.ceil(np.log2(max(capacity, 1) / 4 / 0.8 + 1))))
        self.slots = np.zeros((n, 4), np.uint16) if slots is None else slots

    @property
    def mask(self) -> np.uint64:
        return np.uint64(len(self.slots) - 1)

    def places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mark, first bucket, second bucket) of each key."""
        mark = (digests[:, 0] >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (digests[:, 1] * _M1 >> np.uint64(20)) & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.uint64) * _M2 >> np.uint64(24)) & self.mask)

    def has(self, digests: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(digests)
        return ((self.slots[one] == mark[:, None]) | (self.slots[two] == mark[:, None])).any(1)

    def _fill(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put marks where their buckets have room; the numbers of those that found none."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        turn = np.arange(len(b)) - np.searchsorted(b, b)  # the how-manieth of its bucket
        free = self.slots[b] == 0
        fits = turn < free.sum(1)
        # The turn-th free slot of the bucket.
        slot = (np.cumsum(free[fits], 1) > turn[fits, None]).argmax(1)
        self.slots[b[fits], slot] = mark[order[fits]]
        return order[~fits]

    def insert(self, digests: np.ndarray) -> bool:
        """Insert each key.  False if room ran out: the filter then is to be built anew, larger."""
        mark, one, two = self.places(digests)
        left = self._fill(mark, one)
        left = left[self._fill(mark[left], two[left])]
        mark, bucket = mark[left], two[left]
        for turn in range(ROUNDS):
            if not len(mark):
                break
            # One mark of each bucket takes a slot; the mark that was there looks for room in its other bucket.
            at, own = np.unique(bucket, return_index=True)
            wait = np.ones(len(mark), bool)
            wait[own] = False
            slot = (mark[own].astype(np.int64) + turn) % 4
            out = self.slots[at, slot]
            self.slots[at, slot] = mark[own]
            mark, bucket = np.concatenate([out, mark[wait]]), np.concatenate([self._other(at, out), bucket[wait]])
            mark, bucket = mark[mark != 0], bucket[mark != 0]
            rest = self._fill(mark, bucket)
            mark, bucket = mark[rest], bucket[rest]
        return not len(mark)

    def delete(self, digests: np.ndarray) -> None:
        """Remove one mark for each key; only keys that were inserted may be deleted."""
        mark, one, two = self.places(digests)
        left = np.arange(len(mark))
        for bucket in (one, two):
            while len(left):
                there = self.slots[bucket[left]] == mark[left, None]
                found = np.nonzero(there.any(1))[0]
                if not len(found):
                    break
                at = bucket[left[found]].astype(np.int64) * 4 + there[found].argmax(1)
                at, own = np.unique(at, return_index=True)  # of keys that meet at one slot, one takes it
                self.slots.reshape(-1)[at] = 0
                left = np.delete(left, found[own])

    @classmethod
    def of(cls, digests: np.ndarray) -> CuckooFilter:
        capacity = len(digests)
        while not (f := cls(capacity)).insert(digests):
            capacity = capacity * 2 + 4
        return f

    def tobytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, 4).copy())
