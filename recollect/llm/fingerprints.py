"""Fingerprints of hashes, and their comparison bit by bit over many at once."""

from __future__ import annotations

import numpy as np

RADIUS = 3
LANES = np.uint64(1) << np.arange(64, dtype=np.uint64)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def of_hashes(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 255 * 256):
        bits = np.unpackbits(h[i : i + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            ones += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return int(LANES[ones * 2 > len(h)].sum()) if (ones * 2 > len(h)).any() else 0


def within(planes: np.ndarray, words: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each pair of a query and a word of lanes, the lanes at most ``radius`` bits away.

    planes[b, w]: bit b of the 64 fingerprints of word w. Counter planes, as many as the radius has bits, count differences
    from where they overflow beyond the radius; one more plane notes that they have. A word all of whose lanes have is
    abandoned.
    """
    count = radius.bit_length()
    preset = (1 << count) - 1 - radius
    near = np.zeros(len(queries), np.uint64)
    alive = np.arange(len(queries))
    w, q = words, queries
    counters = [np.full(len(q), ALL if preset >> k & 1 else 0, np.uint64) for k in range(count)]
    over = np.zeros(len(q), np.uint64)
    for b in range(64):
        carry = planes[b, w] ^ (-((q >> np.uint64(b)) & np.uint64(1)).astype(np.int64)).view(np.uint64)
        for c in counters:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if b % 8 == 7 and b < 63:
            left = over != ALL
            if not left.all():
                alive, w, q, over = alive[left], w[left], q[left], over[left]
                counters = [c[left] for c in counters]
                if not len(alive):
                    return near
    near[alive] = ~over
    return near


def sliced(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints, 64 to a word; lanes beyond the last hold nothing (callers mask them)."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    lanes = padded.reshape(-1, 64)
    return np.stack([(((lanes >> np.uint64(b)) & np.uint64(1)) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) for b in range(64)])
