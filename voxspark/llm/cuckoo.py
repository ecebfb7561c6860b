"""A cuckoo filter over 128-bit keys, vectorised.

Each key leaves a fingerprint of 16 bits in one of two buckets of four slots.  Keys are
told in with few false positives and no false negatives, and can be taken out again.
Fingerprints that find no place after many moves go to an exact overflow list.
"""

from __future__ import annotations

import numpy as np

from .bytehash import U, mix

KEY = "S16"
SLOTS = 4
FULL = 0.85
MOVES = 200


def _ranks(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    out = np.empty(len(values), dtype=np.int64)
    out[order] = np.arange(len(values)) - start
    return out


class CuckooFilter:
    def __init__(self, keys: int = 0):
        buckets = 64
        while buckets * SLOTS * FULL < keys:
            buckets *= 2
        self.slots = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.over = np.empty(0, dtype=np.int64)  # bucket and fingerprint of those without a place
        self.count = 0

    def room(self, more: int) -> bool:
        return self.count + more <= self.slots.size * FULL

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets."""
        words = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
        fp = (words[:, 0] >> U(40)).astype(np.uint16)
        fp[fp == 0] = 1
        first = (words[:, 1] & U(len(self.slots) - 1)).astype(np.int64)
        return fp, first, self._other(first, fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(fp.astype(U)) & U(len(self.slots) - 1)).astype(np.int64)

    def _code(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return np.minimum(bucket, self._other(bucket, fp)) << 16 | fp

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(keys)
        out = (self.slots[a] == fp[:, None]).any(axis=1) | (self.slots[b] == fp[:, None]).any(axis=1)
        return out | np.isin(self._code(a, fp), self.over) if len(self.over) else out

    def insert(self, keys: np.ndarray) -> None:
        """Take in keys that are different and not in it; see that there is room."""
        self.count += len(keys)
        fp, at, other = self._places(keys)
        for move in range(MOVES):
            if not len(fp):
                return
            rank = _ranks(at)
            free = self.slots[at] == 0
            fits = rank < free.sum(axis=1)
            slot = np.argmax(np.cumsum(free, axis=1) == rank[:, None] + 1, axis=1)
            self.slots[at[fits], slot[fits]] = fp[fits]
            fp, at, rank = fp[~fits], at[~fits], rank[~fits]
            if move == 0:
                at = other[~fits]
                continue
            # one a bucket takes the place of another, which goes to its own other bucket; the rest wait
            turn = _ranks(at) == 0
            b, s = at[turn], (mix(at[turn].astype(U) + U(move)) & U(SLOTS - 1)).astype(np.int64)
            out = self.slots[b, s]
            self.slots[b, s] = fp[turn]
            fp[turn], at[turn] = out, self._other(b, out)
            gone = fp == 0  # there was room after all
            fp, at = fp[~gone], at[~gone]
        self.over = np.concatenate([self.over, self._code(at, fp)])

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that are different and were taken in."""
        self.count -= len(keys)
        fp, a, b = self._places(keys)
        while len(fp):
            code = self._code(a, fp)
            turn = _ranks(code) == 0
            f, code = fp[turn], code[turn]
            where = a[turn].copy()
            miss = ~(self.slots[where] == f[:, None]).any(axis=1)
            where[miss] = b[turn][miss]
            match = self.slots[where] == f[:, None]
            has = match.any(axis=1)
            self.slots[where[has], np.argmax(match[has], axis=1)] = 0
            for c in code[~has]:
                at = np.flatnonzero(self.over == c)[:1]
                self.over = np.delete(self.over, at)
            fp, a, b = fp[~turn], a[~turn], b[~turn]

    def to_bytes(self) -> bytes:
        head = np.array([len(self.slots), len(self.over), self.count], dtype="<i8")
        return head.tobytes() + self.slots.astype("<u2").tobytes() + self.over.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets, over, count = (int(x) for x in np.frombuffer(data, dtype="<i8", count=3))
        out = cls()
        out.slots = np.frombuffer(data, dtype="<u2", count=buckets * SLOTS, offset=24).reshape(buckets, SLOTS).astype(np.uint16)
        out.over = np.frombuffer(data, dtype="<i8", count=over, offset=24 + 2 * buckets * SLOTS).astype(np.int64)
        out.count = count
        return out
