"""Vectorised 64-bit hashes of the words and byte windows of many texts at once.

The hash of a run of bytes is a sum of random numbers, one per byte value, weighted by powers of an
odd number at the byte's place; prefix sums give any run in constant time, and dividing by the power
at its start makes it independent of place. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(7))
_BYTES = _rng.integers(1, 1 << 64, 256, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)]), dtype=U64)
                for b in (_BASE, _INVERSE)
            )
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(data: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """Weighted prefix sums of bytes, one more than there are bytes; fold maps bytes to bytes first."""
    weights = _BYTES if fold is None else _BYTES[fold]
    up, _ = POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(weights[data] * up[: len(data)], out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs between starts and ends."""
    _, down = POWERS.upto(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts of a column in chunks: number of the first row, bytes, and bounds of each text in them.

    A chunk has about `most` bytes, or one text if that is longer. Nulls are empty texts.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        upto = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        own = bounds[row : upto + 1]
        yield row, data[own[0] : own[-1]], own - own[0]
        row = upto


def words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts, and for each text the number of words before it."""
    inside = is_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = bounds[1:-1]
    before[edges[edges < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = bounds[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)
