"""Hashes of words and shingles of whole Arrow text columns, by numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
_U = np.uint64
# An odd multiplier has an inverse modulo 2**64, so prefix sums give the hash of any stretch.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        row = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        row[0] = 1
        held = _powers[base] = np.cumprod(row)
    return held[:n]


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words start (one more
    entry than texts). Words are parted by ASCII white space; null texts have none. ``lower`` lower-cases A-Z first."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    n = len(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    sums = np.concatenate([[_U(0)], np.cumsum(_LETTERS[data] * _power(_BASE, n))])
    hashes = mix((sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingles_of(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words of one text; one for all its words where it has fewer."""
    n = len(words)
    if n == 0:
        return words
    size = min(SHINGLE_WORDS, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        out = mix(out * _U(_BASE) + words[k : n - size + 1 + k] + _U(k + 1))
    return out


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingles told apart by how often they have occurred before; a first occurrence keeps its
    hash, whether or not its text repeats any."""
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    if not len(same):
        return shingles
    starts = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.maximum.accumulate(np.where(starts, np.arange(len(ordered)), 0))
    out = np.empty_like(shingles)
    before = (np.arange(len(ordered)) - first).astype(np.uint64)
    out[order] = np.where(before == 0, ordered, mix(ordered + before * _U(_BASE)))
    return out
