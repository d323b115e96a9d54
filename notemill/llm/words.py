"""Word hashes of Arrow text columns, computed on whole byte buffers.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return. All work is on slices of whole texts of about ``CHUNK`` bytes
(one text if it is longer), so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(_U(seed) * _U(0xD1342543DE82EF95) + np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_EXACT = stream(7, 256)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_BASE = _U(0x9E3779B97F4A7C55)


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    out[1:] = _BASE
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


def text_slices(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column without nulls: (first row, end row, bytes, offsets from 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + chunk, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all words, and the number of words of each text.

    ``space`` tells which of the 256 byte values separate words.
    """
    inside = ~space[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    return starts, lengths, np.diff(np.searchsorted(starts, offsets))


def word_hashes(
    data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE
) -> np.ndarray:
    """A 64-bit hash of each word of ``words``; ``lower`` folds A-Z."""
    global _POWERS
    if not len(starts):
        return np.zeros(0, _U)
    longest = int(lengths.max())
    if longest > len(_POWERS):
        powers = _powers(longest)
        if longest <= 1 << 16:
            _POWERS = powers
    else:
        powers = _POWERS
    base = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(base, lengths)
    letters = data[~space[data]]
    with np.errstate(over="ignore"):
        values = (_LOWER if lower else _EXACT)[letters] * powers[place]
        return mix(np.add.reduceat(values, base) + lengths.astype(_U))


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` adjacent words, and how many each text has.

    A text of fewer words has one shingle, its whole sequence; one without words none.
    """
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    begin = np.cumsum(counts) - counts
    out_begin = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(out_begin, n) + np.repeat(begin, n)
    left = np.repeat(begin + counts, n) - at
    out = np.zeros(len(at), _U)
    seeds = stream(11, width)
    with np.errstate(over="ignore"):
        for k in range(width):
            there = left > k
            part = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else out
            out = np.where(there, mix(out * _U(0x9E3779B97F4A7C15) + part * (seeds[k] | _U(1))), out)
    return out, n
