"""Whole-batch word splitting and hashing over the bytes of Arrow string columns.

Words are the runs of `[^\\x20\\x09-\\x0D]`; only the letters A-Z are lower-cased. UTF-8 never uses a byte
below 0x80 inside a longer character, so both rules hold on bytes as they do on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash's base modulo 2**64; the table grows with the longest word seen."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 2 * len(_powers), 256), _BASE, dtype=np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about `most` bytes: first row, row after the last, bytes, offsets."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = offsets[:-1] < offsets[1:]
    begins, ends = offsets[:-1][full], offsets[1:][full] - 1
    first[begins] = solid[begins]
    last[ends] = solid[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word after lower-casing A-Z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    before = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum())) - np.repeat(before, lens)
    solid = data[np.repeat(starts, lens) + at]
    sums = np.add.reduceat(_BYTE[LOWER[solid]] * powers(int(lens.max()))[at], before)
    return mix(sums ^ (lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word runs of one document; fewer words than `size` make one run."""
    if not len(hashes):
        return hashes
    n = min(size, len(hashes))
    keys = powers(size + 2)[2 : 2 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    runs = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        runs += hashes[i : len(hashes) - n + 1 + i] * keys[i]
    return np.unique(mix(runs ^ np.uint64(n)))
