"""Whole-column text work in numpy: words, hashes and n-grams of Arrow string arrays, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def word_table(inside) -> np.ndarray:
    """256 entries: 0 for separators, else the byte with A-Z lower-cased. inside(byte) tells word bytes after lower-casing."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if inside(low):
            table[b] = low
    return table


#: Digits, letters and everything beyond ASCII.
ALNUM = word_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Anything but the space and the five ASCII white-space controls.
NON_SPACE = word_table(lambda b: b != 32 and not 9 <= b <= 13)


@dataclass
class Words:
    """Words of consecutive rows: hash, byte span in `data`, and row bounds (row r has words bounds[r]:bounds[r + 1])."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets (len + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows of about `size` bytes."""
    data, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, cuts: np.ndarray | None = None) -> Words:
    """Words of the rows under a word_table; cuts marks bytes at which a new word begins in any case."""
    low = table[data]
    inside = low != 0
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True  # a word never crosses rows
    if cuts is not None:
        edge[:-1] |= cuts
    before = np.zeros(len(low), bool)
    before[1:] = inside[:-1]
    first = inside & (~before | edge[:-1])
    after = np.zeros(len(low), bool)
    after[:-1] = inside[1:]
    last = inside & (~after | edge[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = power_tables(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[low] * up[: len(low)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), low)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (across rows as well: mask those with gram_mask)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * _BASE + hashes[j : j + n]
    return mix(out)


def gram_mask(bounds: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which of the total - k + 1 grams lie within one row."""
    n = max(0, total - k + 1)
    ok = np.ones(n, bool)
    for j in range(1, k):
        at = bounds[1:-1] - j
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i; empty segments give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:], dtype=total.dtype)
    return total[bounds[1:]] - total[bounds[:-1]]
