"""Vectorised text helpers that run inside Arrow tasks.

All work is on the UTF-8 bytes of whole Arrow batches, cut into slices of about a MB so
that a task's memory does not follow the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: The word separators of every operator here: space and U+0009 to U+000D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
#: The same, and all ASCII that is neither letter nor digit.
_MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_C1, _C2, _C3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows with at most limit bytes, or one longer row: first row, end row, bytes, offsets."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, A to Z in lower case, and the word offsets of the rows.

    marks: punctuation separates words too.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~(_MARKS if marks else _SPACE)[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = offsets[offsets < len(data)]
    start[edge] = inside[edge]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    edge = offsets[offsets > 0] - 1
    stop[edge] = inside[edge]
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * up[: len(data)], out=total[1:])
    return mix((total[last] - total[first]) * down[first]), np.searchsorted(first, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sorted distinct word-shingle hashes and their offsets.

    A row with fewer words than the width has the whole sequence as one shingle; a row
    without words has none.
    """
    h, w = words(data, offsets)
    count = np.diff(w)
    full = np.maximum(count - width + 1, 0)
    n_sh = np.where(full > 0, full, (count > 0).astype(np.int64))
    sh_off = np.concatenate([[0], np.cumsum(n_sh)])
    if not sh_off[-1]:
        return np.zeros(0, np.uint64), sh_off
    row = np.repeat(np.arange(len(count)), n_sh)
    at = w[row] + np.arange(sh_off[-1]) - sh_off[row]
    length = np.minimum(count[row], width)
    value = length.astype(np.uint64)
    for k in range(width):
        there = length > k
        value[there] = mix(value[there] * _C3 + h[at[there] + k])
    for i in np.flatnonzero(n_sh > 1):
        value[sh_off[i] : sh_off[i + 1]].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(count)))])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
