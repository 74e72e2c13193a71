"""Work along the rows of tiles that window functions can't express, and lower envelopes of parabolas.

Cells travel one by one and sorted, not as arrays, so an Arrow batch is small however wide a tile is. A
task holds some whole rows of tiles at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Cells that a task gathers before it works on them; a single row of a tile may be longer.
LINE_CELLS = 1 << 17
_MOST = np.iinfo(np.int64).max


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The places where a group begins."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        codes = table[k].combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        codes = codes.indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], cells: int = LINE_CELLS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a partition that is sorted by keys, and where each group begins."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= cells:
            table = pa.Table.from_batches(held)
            starts = _changes(table, keys)
            last = int(starts[-1])
            if last:
                yield table.slice(0, last), starts[:-1]
            held, count = table.slice(last).to_batches(), table.num_rows - last
    if held:
        table = pa.Table.from_batches(held)
        yield table, _changes(table, keys)


def _work(batches: Iterator[pa.RecordBatch], work: Callable, reads: list[str], cells: int) -> Iterator[pa.RecordBatch]:
    for table, starts in whole_groups(batches, ["tile", "row"], cells):
        sizes = np.diff(np.r_[starts, table.num_rows])
        col = table["col"].to_numpy().astype(np.int64)
        width = np.maximum.reduceat(col, starts) + 1
        line = np.repeat(np.arange(len(starts)), sizes)
        values = {c: table[c].to_numpy() for c in reads}
        out: dict[str, np.ndarray] = {}
        # rows of similar widths share a matrix, so that a wide one doesn't widen all
        size = np.ceil(np.log2(width)).astype(int)
        for s in np.unique(size):
            own = np.flatnonzero(size == s)
            at = np.flatnonzero(size[line] == s)
            place = np.zeros(len(starts), np.int64)
            place[own] = np.arange(len(own))
            i, j = place[line[at]], col[at]
            shape = (len(own), int(width[own].max()))
            matrices = {}
            for c, v in values.items():
                m = np.full(shape, np.nan)
                m[i, j] = v[at]
                matrices[c] = m
            for name, m in work(matrices).items():
                out.setdefault(name, np.full(table.num_rows, np.nan))[at] = m[i, j]
        added = [pa.array(v, mask=np.isnan(v)) for v in out.values()]
        full = pa.Table.from_arrays([*table.columns, *added], [*table.column_names, *out])
        yield from full.to_batches(max_chunksize=1 << 14)


def along_rows(cells: DataFrame, work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], reads: list[str], adds: list[str], line_cells: int = LINE_CELLS) -> DataFrame:
    """cells with columns of doubles that work makes of whole rows of tiles.

    work gets a matrix of doubles for each column in reads (NaN: NULL or no such cell), a
    line for each row of a tile and a place for each col from 0 on, and returns matrices of the same shape, NaN for NULL.
    """
    schema = T.StructType([*(f for f in cells.schema.fields if f.name not in adds), *(T.StructField(a, T.DoubleType()) for a in adds)])
    kept = cells.drop(*adds)
    dealt = kept.repartition("tile", "row").sortWithinPartitions("tile", "row", "col")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _work(batches, work, reads, line_cells):
            yield b.select(schema.names)

    return dealt.mapInArrow(run, schema)


def envelope(height: np.ndarray, rank: np.ndarray | None = None, one_sided: bool = False) -> np.ndarray:
    """For each line of integers and each place x the column c whose parabola (x - c)² + height[c] is the lowest at x; -1 without any.

    height: negative where there is no parabola. With one_sided only columns c <= x count. Of equal ones that of
    the smaller rank wins (different numbers from 0 on; by default the smaller c, one-sided the larger). Columns are
    taken from left to right for all lines at once: a stack holds those that are the lowest somewhere, each with the first
    place that it takes over, and a new one removes those that it overtakes before they begin. So each
    column is put in once and taken out once at the most.
    """
    lines, width = height.shape
    if rank is None:
        rank = np.broadcast_to(width - 1 - np.arange(width) if one_sided else np.arange(width), height.shape)
    # ranks are fractions of a unit of height, all in whole numbers
    unit = int(rank.max(initial=0)) + 1
    if (int(height.max(initial=0)) + width * width) * 4 * unit >= _MOST:
        raise ValueError("rasters of that size go beyond 64-bit numbers")
    f = height * unit + rank
    stack, since = np.zeros((2, lines, width + 1), np.int64)
    top = np.full(lines, -1)
    for q in range(width):
        rest = np.flatnonzero(height[:, q] >= 0)
        while len(rest):
            k = top[rest]
            v = stack[rest, np.maximum(k, 0)]
            over = unit * (q * q - v * v) + f[rest, q] - f[rest, v]
            begins = np.where(k < 0, 0, over // np.maximum(2 * unit * (q - v), 1) + 1)
            if one_sided:
                begins = np.maximum(begins, q)
            gone = (k >= 0) & (begins <= since[rest, np.maximum(k, 0)])
            put = ~gone & (begins < width)
            rows, at = rest[put], k[put] + 1
            stack[rows, at], since[rows, at], top[rows] = q, begins[put], at
            rest = rest[gone]
            top[rest] -= 1
    owner = np.full((lines, width), -1)
    i, j = np.nonzero(np.arange(width + 1)[None] <= top[:, None])
    owner[i, since[i, j]] = j
    owner = np.maximum.accumulate(owner, axis=1)
    return np.where(owner >= 0, np.take_along_axis(stack, np.maximum(owner, 0), axis=1), -1)
