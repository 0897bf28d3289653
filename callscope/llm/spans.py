"""Spans of bytes as arrays: 64-bit hashes of many spans at once, and whether they equal the keys of a table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

#: The odd constants of the 64-bit finaliser, and the golden ratio that parts seeds.
FIRST, SECOND, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Of eight bytes, those that a span of so many has.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans above this length are hashed as a whole, one by one.
LONG = 512


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * FIRST
    x = (x ^ (x >> np.uint64(27))) * SECOND
    return x ^ (x >> np.uint64(31))


def windows(data: bytes) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), data + bytes(8), strides=(1,))


def hash_spans(view: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of windows(data); equal bytes have equal hashes, in any data."""
    found = mixed(length.astype(np.uint64) + GOLDEN)
    active, done = np.flatnonzero(length <= LONG), 0
    while len(active := active[length[active] > done]):
        part = view[start[active] + done] & MASKS[np.minimum(length[active] - done, 8)]
        found[active] = mixed((found[active] ^ part) + GOLDEN)
        done += 8
    for k in np.flatnonzero(length > LONG):
        whole = view.base[start[k] : start[k] + length[k]]
        found[k] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")
    return found


class PerfectHash:
    """A minimal perfect hash of distinct keys by hash and displace: each key has a slot of its own, of as many slots as keys.

    A bucket of keys has a displacement that moves them all to free slots; a bucket of one key names its
    slot. A lookup reads the displacement and compares the key in the slot, byte by byte, so that
    spans which are no keys are told apart exactly.
    """

    def __init__(self, keys: Sequence[bytes], values: Sequence[int], per_bucket: int = 3):
        self.longest = max(map(len, keys), default=0)
        if self.longest > LONG:
            raise ValueError(f"keys must have {LONG} bytes at most")
        length = np.array([len(k) for k in keys], np.int64)
        start = np.cumsum(length) - length
        data = b"".join(keys)
        hashes = hash_spans(windows(data), start, length)
        if len(np.unique(hashes)) < len(keys):
            raise ValueError("keys must differ")
        self.buckets, self.slots = np.uint64(max(1, len(keys) // per_bucket)), np.uint64(max(1, len(keys)))
        self.shift = np.zeros(int(self.buckets), np.int64)
        order = self._place(hashes)[: len(keys)]
        self.data, self.length, self.start = data, length[order], start[order]
        self.values = np.asarray(values, np.int64)[order]

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        """The key in each slot; fills the displacements, large buckets first."""
        taken, key_of = np.zeros(int(self.slots), bool), np.zeros(int(self.slots), np.int64)
        bucket = (hashes % self.buckets).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=int(self.buckets)))
        sizes = np.diff(ends, prepend=0)
        seeds = np.arange(1, 257, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            own = by_bucket[ends[b] - sizes[b] : ends[b]]
            if len(own) < 2:
                break
            tried = np.uint64(0)
            while True:
                slots = (mixed(hashes[own][None, :] + (seeds + tried)[:, None] * GOLDEN) % self.slots).astype(np.int64)
                spread = np.sort(slots, axis=1)
                good = np.flatnonzero(~taken[slots].any(axis=1) & (spread[:, 1:] != spread[:, :-1]).all(axis=1))
                if len(good):
                    break
                tried += np.uint64(len(seeds))
            self.shift[b] = int(seeds[good[0]] + tried)
            taken[slots[good[0]]], key_of[slots[good[0]]] = True, own
        free = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(sizes == 1):
            slot = next(free)
            self.shift[b], key_of[slot] = -1 - slot, by_bucket[ends[b] - 1]
        return key_of

    def find(self, view: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The value of each span that is a key, -1 for the others."""
        found = np.full(len(start), -1, np.int64)
        if not len(self.values):
            return found
        able = np.flatnonzero(length <= self.longest)
        start, length = start[able], length[able]
        hashes = hash_spans(view, start, length)
        shift = self.shift[(hashes % self.buckets).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, (mixed(hashes + shift.astype(np.uint64) * GOLDEN) % self.slots).astype(np.int64))
        alike = np.flatnonzero(self.length[slot] == length)
        own, done, same = windows(self.data), 0, np.ones(len(alike), bool)
        at, key, size = start[alike], self.start[slot[alike]], length[alike]
        active = np.arange(len(alike))
        while len(active := active[size[active] > done]):
            differ = (view[at[active] + done] ^ own[key[active] + done]) & MASKS[np.minimum(size[active] - done, 8)]
            same[active[differ != 0]] = False
            done += 8
        hit = alike[same]
        found[able[hit]] = self.values[slot[hit]]
        return found
