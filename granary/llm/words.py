"""Words of UTF-8 text (runs of bytes other than ASCII white space) as 64-bit hashes, with numpy.

A word's hash is a sum over its bytes of a table entry times a weight of the
position in the word, modulo 2**64, mixed at the end; tables come from a fixed
mixing function, so values are alike on every machine. Text is read in slices, and a
word that goes on in the next slice is carried as its sum and length, so temporary
arrays stay small for texts and words of any length.
"""

from __future__ import annotations

import numpy as np

SLICE = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which near inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def table(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit values."""
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)) | np.uint64(1)


BYTES = table(256, 1)
#: A position's weight: the product of an entry for its low bits and one for the bits above.
WEIGHTS, HIGH = table(4096, 2), table(4096, 6)


def _weight(position: np.ndarray) -> np.ndarray:
    low = WEIGHTS[position & 4095]
    return low * HIGH[position >> 12 & 4095] if len(position) and position.max() > 4095 else low * HIGH[0]


def hashed_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and hashes of all words."""
    a = np.frombuffer(text, np.uint8)
    starts, sums, sizes = [], [], []
    begun = None  # offset, sum and length of a word that the slice before ended in
    for at in range(0, len(a), SLICE):
        part = a[at : at + SLICE]
        inside = ~SPACE[part]
        edge = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        n = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1 - edge
        first = np.cumsum(n) - n
        pos = np.arange(int(n.sum())) - np.repeat(first, n)
        goes_on = begun is not None and bool(inside[0])
        if goes_on:
            pos[: n[0]] += begun[2]
        total = np.add.reduceat(BYTES[part[inside]] * _weight(pos), first) if len(edge) else np.zeros(0, np.uint64)
        edge = edge + at
        if goes_on:
            edge[0], total[:1], n[0] = begun[0], total[:1] + begun[1], n[0] + begun[2]
        elif begun is not None:
            edge, total, n = (np.concatenate(([x], y)) for x, y in zip(begun, (edge, total, n), strict=True))
        begun = (edge[-1], total[-1], n[-1]) if inside[-1] and at + SLICE < len(a) else None
        keep = slice(0, len(edge) - (begun is not None))
        starts.append(edge[keep])
        sums.append(total[keep].astype(np.uint64))
        sizes.append(n[keep].astype(np.uint64))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts).astype(np.int64), mix(np.concatenate(sums) + np.concatenate(sizes))


STEP = np.uint64(0xA24BAED4963EE407)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words (none where there are fewer)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    last = len(hashes) - n + 1
    g = hashes[:last].copy()
    for k in range(1, n):
        g = g * STEP + hashes[k : k + last]
    return mix(g)
