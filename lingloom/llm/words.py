"""Words of whole text columns, found and hashed in numpy over Arrow buffers.

A word is a run of bytes outside space and tab to carriage return. Work goes in slices of about a megabyte of text,
so memory does not follow the size of a batch; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Odd multipliers of the two word hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all bits."""
    x = x ^ (x >> u64(32))
    x = x * u64(0xD6E8FEB86659FD93)
    x = x ^ (x >> u64(32))
    x = x * u64(0xD6E8FEB86659FD93)
    return x ^ (x >> u64(32))


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i up to n."""
    if which not in _powers or len(_powers[which][0]) <= n:
        r = MULTIPLIERS[which]
        pair = []
        for base in (r, pow(r, -1, 1 << 64)):
            out = np.full(max(n, SLICE) + 1, u64(base))
            out[0] = 1
            pair.append(np.multiply.accumulate(out))
        _powers[which] = (pair[0], pair[1])
    return _powers[which]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of rows of at most limit bytes, one row at least."""
    data, offsets = flat(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    """Words of a slice: byte positions, and for each row the index of its first word (and one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        up, down = powers(which, len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + u64(1)) * up[: len(self.data)], out=total[1:])
        return mixed((total[self.ends] - total[self.starts]) * down[self.starts])


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~SPACE[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[1:-1]
    before[inner[inner < n]] = False
    after[inner[inner > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    return Words(data, starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, offsets))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def sequences(hashes: np.ndarray, first: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `size` words that stays in its row, and the index of the first word of each run."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(which, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    counts = np.diff(first)
    last = np.repeat(first[1:], counts)  # the end of the row of each word
    at = np.flatnonzero(np.arange(n) + size <= last)
    return mixed((total[at + size] - total[at]) * down[at]), at
