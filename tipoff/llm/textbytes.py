"""Numpy helpers over the bytes of an Arrow string column: words, spans and their 64-bit hashes.

Everything works on a slice of some documents at a time, without a loop over documents or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = (1 << 64) - 1


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece hold about ``max_bytes``; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and n + 1 offsets into them. Null texts are empty."""
    array = array.fill_null("").cast(pa.large_binary()) if array.null_count else array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit polynomial hashes of any spans of one byte array, from its prefix sums.

    Bytes are replaced by random odd numbers first. ``lower`` gives A-Z the numbers of a-z.
    """

    def __init__(self, seed: int, *, lower: bool = False):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            self.table[65:91] = self.table[97:123]
        self.base = int(rng.integers(1 << 58, 1 << 60)) * 8 + 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out, have, step = np.ones(n, np.uint64), 1, base
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = out[:more] * np.uint64(step)
            have, step = have + more, step * step & _MASK
        return out

    def load(self, data: np.ndarray) -> SpanHash:
        return self.load_numbers(self.table[data])

    def load_numbers(self, numbers: np.ndarray) -> SpanHash:
        """As ``load``, for a row of any 64-bit numbers in place of bytes."""
        n = len(numbers)
        if len(self.up) <= n:
            self.up, self.down = self._powers(self.base, n + 1), self._powers(self.inverse, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(numbers * self.up[:n], out=self.sums[1:])
        return self

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inner = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix64(inner + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """Words of some texts: byte spans, and for each text the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        black = np.ones(len(data) + 2, dtype=np.int8)
        black[0] = black[-1] = 0
        black[1:-1] = ~space[data]
        step = np.diff(black)
        starts, ends = np.flatnonzero(step[:-1] == 1), np.flatnonzero(step[1:] == -1) + 1
        # A word that goes over the edge of a text is cut there.
        edge = offsets[1:-1]
        edge = np.unique(edge[(edge > 0) & (edge < len(data))]) if len(edge) else edge
        if len(edge):
            edge = edge[~space[data[edge]] & ~space[data[edge - 1]]]
            starts, ends = np.sort(np.concatenate([starts, edge])), np.sort(np.concatenate([ends, edge]))
        self.starts, self.ends = starts, ends
        self.range = np.searchsorted(starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.range)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.range) - 1), self.counts)


def windows(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row inside one text, and the index of their first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k])
    first = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    return out[first], first
