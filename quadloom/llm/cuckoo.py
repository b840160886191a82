"""A cuckoo filter over 64-bit hashes: insert, delete and test, in numpy."""

from __future__ import annotations

import numpy as np

SLOTS = 4
MAX_KICKS = 500
#: The share of slots beyond which a table counts as full; kick chains stay short below it.
MAX_LOAD = 0.8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


class CuckooFilter:
    """16-bit fingerprints, four slots a bucket, a power of two of buckets.

    The filter holds one fingerprint per inserted hash, so a delete of an
    inserted hash takes out exactly one and never hides another hash.
    """

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        need = max(1, int(capacity / (SLOTS * MAX_LOAD)) + 1)
        self.table = np.zeros((1 << (need - 1).bit_length(), SLOTS), np.uint16) if table is None else table
        self.mask = np.uint64(len(self.table) - 1)
        self.used = int(np.count_nonzero(self.table))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _mix(hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes)
        fp = ((h >> np.uint64(48)) & np.uint64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        first = (h & self.mask).astype(np.int64)
        return fp, first, self._other(first, fp)

    def _other(self, place: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return ((place.astype(np.uint64) ^ _mix(fp.astype(np.uint64) + np.uint64(1))) & self.mask).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, bool)
        fp, a, b = self._places(hashes)
        return ((self.table[a] == fp[:, None]) | (self.table[b] == fp[:, None])).any(1)

    def insert(self, hashes: np.ndarray) -> np.ndarray:
        """Insert distinct hashes; returns those that found no room (the filter is then as before them)."""
        room = max(0, int(MAX_LOAD * self.table.size) - self.used)
        hashes, later = hashes[:room], hashes[room:]
        if not len(hashes):
            return later
        fp, a, b = self._places(hashes)
        left = np.arange(len(fp))
        for at in (a, b):
            left = left[~self._place(at[left], fp[left])]
        failed = [i for i in left if not self._kick(fp[i], int(a[i]))]
        self.used += len(hashes) - len(failed)
        return np.concatenate([hashes[failed], later])

    def _place(self, at: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Fill free slots, several hashes of a bucket in one go; which found one."""
        order = np.argsort(at, kind="stable")
        run = at[order]
        start = np.r_[True, run[1:] != run[:-1]]
        first = np.flatnonzero(start)
        rank = np.arange(len(run)) - np.repeat(first, np.diff(np.r_[first, len(run)]))
        free = self.table[run] == 0
        fits = rank < free.sum(1)
        slot = np.argmax(free.cumsum(1) == (rank + 1)[:, None], 1)
        self.table[run[fits], slot[fits]] = fp[order][fits]
        done = np.zeros(len(at), bool)
        done[order[fits]] = True
        return done

    def _kick(self, fp: np.uint16, at: int) -> bool:
        """Move fingerprints to their other buckets until one finds room; undone if none does."""
        table, path = self.table, []
        for kicks in range(MAX_KICKS):
            free = np.flatnonzero(table[at] == 0)
            if len(free):
                table[at, free[0]] = fp
                return True
            slot = (int(fp) + kicks) % SLOTS
            path.append((at, slot, table[at, slot]))
            fp, table[at, slot] = table[at, slot], fp
            at = int(self._other(np.array([at]), np.array([fp], np.uint16))[0])
        for at, slot, was in reversed(path):
            table[at, slot] = was
        return False

    def delete(self, hashes: np.ndarray) -> np.ndarray:
        """Take out one fingerprint a hash; returns the hashes that had none."""
        missing = []
        for i, (fp, *places) in enumerate(zip(*self._places(hashes), strict=True) if len(hashes) else ()):
            for at in places:
                found = np.flatnonzero(self.table[at] == fp)
                if len(found):
                    self.table[at, found[0]] = 0
                    self.used -= 1
                    break
            else:
                missing.append(i)
        return hashes[missing]


class ShardFilter:
    """A shard's filter: one table, and exact hashes of what the table has no room for.

    One table alone makes deletes safe: a hash's fingerprint lies in the table or
    the hash lies in the list, so taking it out never takes another hash's place.
    Who keeps the hashes makes a larger filter before the list grows long.
    """

    def __init__(self, planned: int = 1, table: CuckooFilter | None = None, listed: np.ndarray | None = None):
        """planned: the number of hashes that the table is made for."""
        self.table = table or CuckooFilter(planned)
        self.listed = np.zeros(0, np.int64) if listed is None else listed  # ascending

    def _in_list(self, hashes: np.ndarray) -> np.ndarray:
        return np.isin(hashes, self.listed) if len(self.listed) else np.zeros(len(hashes), bool)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        return self.table.contains(hashes) | self._in_list(hashes)

    def insert(self, hashes: np.ndarray) -> None:
        left = self.table.insert(hashes)
        if len(left):
            self.listed = np.sort(np.concatenate([self.listed, left]))

    def delete(self, hashes: np.ndarray) -> None:
        listed = self._in_list(hashes)
        if listed.any():
            self.listed = np.delete(self.listed, np.searchsorted(self.listed, hashes[listed]))
        self.table.delete(hashes[~listed])

    @property
    def used(self) -> int:
        return self.table.used + len(self.listed)

    def to_bytes(self) -> bytes:
        return np.array([len(self.table.table), len(self.listed)], np.int64).tobytes() + self.table.table.tobytes() + self.listed.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> ShardFilter:
        rows, listed = (int(x) for x in np.frombuffer(raw, np.int64, 2))
        table = np.frombuffer(raw, np.uint16, rows * SLOTS, 16).reshape(-1, SLOTS).copy()
        return cls(0, CuckooFilter(0, table), np.frombuffer(raw, np.int64, listed, 16 + table.nbytes).copy())
