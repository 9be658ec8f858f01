"""Hashes of all words and lines of a byte buffer at once, in numpy.

A word's hash is the difference of two prefix sums of byte * ODD**position,
scaled back by the inverse power (all modulo 2**64), then mixed. Nothing loops
over words or bytes in Python.
"""

from __future__ import annotations

import numpy as np

ODD = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(ODD, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and INVERSE**i for i < n, kept between calls."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((ODD, INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    out = h >> np.uint64(33)
    out ^= h
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    out ^= out >> np.uint64(33)
    return out


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent hash of values[start:end] for every span; values are unsigned 64-bit."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    scaled = values + np.uint64(1)
    scaled *= up[: len(values)]
    np.cumsum(scaled, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(buffer: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where blank is false."""
    around = np.concatenate([[True], blank, [True]])
    edge = np.flatnonzero(around[1:] != around[:-1])
    return edge[::2].copy(), edge[1::2].copy()


#: A byte's bits, most significant first, as ones in the eight bytes of a word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
PIECE = 255  # so many hashes can be added up in byte-wide counters


def simhashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of hashes[start:end] for consecutive, non-empty, gapless spans: a bit is one if it is in over half of them.

    Eight counters of one byte are added at a time; longer spans are added up
    in pieces first.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = (ends - starts).astype(np.int64)
    pieces = -(-size // PIECE)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    cuts = np.repeat(starts, pieces) + PIECE * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    octets = hashes[starts[0] : ends[-1]].astype(">u8").view(np.uint8).reshape(-1, 8)
    sums = np.empty((len(cuts), 8), np.uint64)
    for k in range(8):
        sums[:, k] = np.add.reduceat(_LANES[octets[:, k]], cuts - starts[0])
    ones = sums.view(np.uint8).reshape(len(cuts), 64)
    ones = np.add.reduceat(ones, first, axis=0, dtype=np.int64) if len(cuts) > len(starts) else ones.astype(np.int64)
    return np.packbits(ones * 2 > size[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
