"""Byte columns of Arrow batches as numpy arrays, and lookup tables for 64-bit keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit integers: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows in them; nulls are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column.fill_null("" if "string" in str(column.type) else b"")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def spans_of_bytes(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """Cuts rows into work of at most ``most`` bytes: (first row, row after the last, from byte, to byte).

    Many short rows go together; a row longer than ``most`` is cut into several items of one row each.
    """
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        if last <= row:
            for at in range(int(offsets[row]), int(offsets[row + 1]), most):
                yield row, row + 1, at, min(at + most, int(offsets[row + 1]))
            row += 1
        else:
            yield row, last, int(offsets[row]), int(offsets[last])
            row = last


class KeyTable:
    """Positions of 64-bit keys in a sorted array: one probe of a hashed slot, binary search only where slots clash."""

    def __init__(self, keys: np.ndarray):
        """``keys``: sorted, distinct."""
        self.keys = keys
        bits = max(8, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int32)
        self.clash = np.zeros(1 << bits, bool)
        if len(keys):
            at = (mix(keys) >> self.shift).astype(np.int64)
            self.slot[at] = np.arange(len(keys), dtype=np.int32)
            self.clash[at[self.slot[at] != np.arange(len(keys))]] = True

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The position of each wanted key, -1 where it is absent."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        at = (mix(wanted) >> self.shift).astype(np.int64)
        got = self.slot[at]
        hit = (got >= 0) & (self.keys[got] == wanted)
        out = np.where(hit, got, -1)
        if len(again := np.flatnonzero(~hit & self.clash[at])):
            place = np.minimum(np.searchsorted(self.keys, wanted[again]), len(self.keys) - 1)
            out[again] = np.where(self.keys[place] == wanted[again], place, -1)
        return out
