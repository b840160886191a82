"""DartMinHash: sketches of weighted sets by throwing hashed darts.

Every element owns a strip, its weight wide and without end in rank. Hashing
throws darts over the strip at unit rate: a cell one unit of weight wide and
one unit of rank high holds a Poisson number of them, at places that depend on
element and cell alone. A dart falls to one of k coordinates; the earliest in
rank among those that hit a set's strips is the coordinate's value. Two sets
agree on a coordinate with the probability of their weighted Jaccard
similarity.

All cells of rank below some height are searched, so what is found earliest is
the earliest of all; sets that leave a coordinate empty are searched higher.
With a height of about k (ln k + 2) over the set's weight, few are. The cost
is the number of elements plus k ln k darts, not their product.
"""

from __future__ import annotations

import math

import numpy as np

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Poisson(1) counts by cumulated probability.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
_TILE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; the argument is an array of its own."""
    x = x + _A
    x ^= x >> np.uint64(30)
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def strips(owner: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements of weight w as ceil(w) strips at most one wide: owner, hash and width."""
    n = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return owner[at], strip_hash(element[at], number), np.minimum(1.0, weight[at] - number)


def strip_hash(element: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix(element ^ (number.astype(np.uint64) * _C))


def sketch(n_sets: int, owner: np.ndarray, strip: np.ndarray, width: np.ndarray | None, k: int) -> np.ndarray:
    """The k earliest darts of each set, as hashes; sets without strips get zeros.

    owner ascends; width is None where all strips are one wide.
    """
    best = np.full(n_sets * k, np.inf)
    darts = np.zeros(n_sets * k, np.uint64)
    size = np.bincount(owner, minlength=n_sets) if width is None else np.bincount(owner, width, n_sets)
    height = np.zeros(n_sets, np.int64)
    height[size > 0] = np.ceil(k * (math.log(k) + 2) / size[size > 0])
    starts = np.searchsorted(owner, np.arange(n_sets + 1))
    low = 0
    active = np.flatnonzero(size > 0)
    while len(active):
        of = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in active]) if len(active) < n_sets else np.arange(len(owner))
        high = low + max(1, min(_TILE // max(1, len(of)), int(height[active].min()) - low if height[active].min() > low else 1))
        for lo in range(0, len(of), _TILE):
            _throw(of[lo : lo + _TILE], low, high, owner, strip, width, k, best, darts)
        low = high
        empty = np.isinf(best.reshape(n_sets, k)[active]).any(1)
        active = active[(height[active] > low) | empty]
    return darts.reshape(n_sets, k)


def _throw(of: np.ndarray, low: int, high: int, owner: np.ndarray, strip: np.ndarray, width: np.ndarray | None, k: int, best: np.ndarray, darts: np.ndarray) -> None:
    cells = np.arange(low, high, dtype=np.uint64)
    cell = mix((strip[of][:, None] ^ mix(cells * _B)[None, :]).ravel())
    at = np.repeat(of, high - low)
    floor = np.tile(cells.astype(np.float64), len(of))
    count = np.searchsorted(_POISSON, _unit(cell))
    for j in range(int(count.max(initial=0))):
        hit = np.flatnonzero(count > j)
        dart = mix(cell[hit] + np.uint64((j + 1) * int(_C) % (1 << 64)))
        rank = floor[hit] + _unit(dart)
        other = mix(dart)
        spot = owner[at[hit]] * k + (other % np.uint64(k)).astype(np.int64)
        better = rank < best[spot]
        if width is not None:
            better &= _unit(mix(other)) < width[at[hit]]
        spot, rank, dart = spot[better], rank[better], dart[better]
        np.minimum.at(best, spot, rank)
        won = rank == best[spot]
        darts[spot[won]] = dart[won]


def band_keys(darts: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of coordinates."""
    n, k = darts.shape
    rows = k // bands
    parts = darts[:, : bands * rows].reshape(n, bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), (n, bands)).copy()
    for r in range(rows):
        key = mix(key ^ parts[:, :, r])
    return key.view(np.int64)
