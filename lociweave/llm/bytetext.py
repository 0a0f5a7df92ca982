"""Vectorised views of the UTF-8 bytes of an Arrow text column."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lociweave.llm.common import mix64

BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)
#: So many powers stay in a worker's memory; those of longer texts are made when they are needed.
KEPT_POWERS = 1 << 20


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, null as empty, and the n + 1 offsets of its rows."""
    column = pc.fill_null(column, "")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or offsets[0] == offsets[-1]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _powers(of: int, size: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    step = np.uint64(of)
    with np.errstate(over="ignore"):
        while len(out) < size:
            out = np.concatenate([out, out * step])
            step = step * step
    return out[:size]


@lru_cache(maxsize=2)
def powers(of: int) -> np.ndarray:
    return _powers(of, KEPT_POWERS)


def powers_of(of: int, size: int) -> np.ndarray:
    """of ** 0, 1, ... modulo 2**64."""
    return powers(of)[:size] if size <= KEPT_POWERS else _powers(of, size)


@lru_cache(maxsize=2)
def letters(fold_case: bool) -> np.ndarray:
    """A random odd number for each byte; with fold_case, A-Z have those of a-z."""
    table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    if fold_case:
        table[65:91] = table[97:123]
    return table


class Rolling:
    """Hashes of any stretch of a byte array from sums of powers; equal stretches have equal hashes."""

    def __init__(self, data: np.ndarray, fold_case: bool = False):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(letters(fold_case)[data] * powers_of(BASE, len(data)), out=self.sums[1:])
        self.back = powers_of(INVERSE, len(data) + 1)

    def __call__(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stops] - self.sums[starts]) * self.back[starts] + (stops - starts).astype(np.uint64))


class RollingValues(Rolling):
    """The same for stretches of an array of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers_of(BASE, len(values)), out=self.sums[1:])
        self.back = powers_of(INVERSE, len(values) + 1)


def words_of(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words of all rows, and the number of words of each row; gap: by byte, whether it parts words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.append(True, ~inside[:-1])))
    stops = np.flatnonzero(inside & (edge[1:] | np.append(~inside[1:], True))) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, stops, counts
