"""Removal of repeated long byte strings by a logarithmic family of sparse suffix arrays.

A suffix array of every byte of 100 TB is many times the text. Repeats of at least `length` bytes
are found from a sparse one: of all k-byte substrings that start in a window of length - k + 1 bytes,
the one with the smallest hash (the leftmost of equals) is that window's anchor. Equal strings of
`length` bytes have equal anchors, so the suffixes that start at anchors, about one in 80 bytes, meet at
every long match. A suffix array holds these suffixes by their first k bytes, in the order of the bytes, each with the
length that it has in common with the one before; and the run of windows that the anchor stands for, with a hash of its bytes.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import discard, scratch, settled, stored, whole_groups, written
from .text import SLICE_BYTES, mix, powers, ragged, slices, utf8

LENGTH, KEY_BYTES = 200, 40
#: Batches in which a table is added to the index: four make one level, which the fifth is scanned against. Distinct runs of one suffix that one task takes.
BATCHES, GROUP_ROWS = 5, 2048
_PLACE = np.uint64((1 << 28) - 1)
_BYTES = np.random.default_rng(5).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _totals(data: np.ndarray, which: int = 0) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[which][data] * powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def _window_hashes(data: np.ndarray, k: int, total: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all k-byte substrings."""
    total = _totals(data) if total is None else total
    return mix((total[k:] - total[:-k]) * powers(len(data) + 1)[1][: len(data) - k + 1])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = KEY_BYTES) -> tuple[np.ndarray, ...]:
    """(row, start, n, place, content): the runs of n windows of each row, from byte start on, with one anchor at a place in data; a hash of their bytes."""
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    empty = np.zeros(0, np.int64)
    if not sizes.any():
        return empty, empty, empty, empty, empty.astype(np.uint64)
    total = _totals(data)
    h = _window_hashes(data, k, total)
    order = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    w = length - k + 1
    padded = np.full(-(-len(order) // w) * w, np.iinfo(np.uint64).max)
    padded[: len(order)] = order
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(order) - w + 1], ahead[w - 1 : len(order)])
    place = (least & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = ragged(offsets[:-1], sizes)
    anchor = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    begin, n = start[first], np.diff(np.r_[first, len(start)])
    content = mix((total[begin + n + length - 1] - total[begin]) * powers(len(data) + 1)[1][begin] + n.astype(np.uint64))
    return row[first], begin - offsets[row[first]], n, anchor[first], content


def _binary(rows: np.ndarray) -> pa.Array:
    """A matrix of bytes as binary values, one for each row."""
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _entries(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    names = ["suffix", "r", "doc_id", "key", "start", "n"]
    for batch in batches:
        data, offsets = utf8(batch["text"])
        doc, key = batch["doc_id"].to_numpy(), batch["key"].to_numpy()
        for lo, hi, part, off in slices(data, offsets):
            # a row longer than a slice goes piece by piece; pieces share the bytes of the windows between them
            step = SLICE_BYTES
            for at in range(0, max(len(part) - length + 1, 1), step) if hi == lo + 1 else [0]:
                piece = part[at : at + step + length - 1] if hi == lo + 1 else part
                row, start, n, place, r = anchors(piece, np.array([0, len(piece)]) if hi == lo + 1 else off, length, k)
                if len(row):
                    suffix = _binary(piece[place[:, None] + np.arange(k)])
                    columns = [r.view(np.int64), doc[lo + row], key[lo + row], (start + at).astype(np.int32), n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([suffix, *(pa.array(c) for c in columns)], names)


def _rows(column: pa.Array, k: int) -> np.ndarray:
    """Binary values of k bytes each as a matrix."""
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * k].reshape(-1, k)


def _common(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Adds to sorted entries lcp, the bytes that a suffix has in common with the one before, and again: whether that is
    all k of them with the one before or after. The ends of a partition, whose neighbours lie in others, count as such."""

    def known(rows: pa.RecordBatch, lcp: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(lcp.astype(np.int32), mask=lcp < 0), pa.array(again)], [*rows.schema.names, "lcp", "again"])

    held, before = None, -1  # the last row, whose next isn't there yet, and its lcp
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        rows = _rows(batch["suffix"], k)
        differ = rows[1:] != rows[:-1]
        lcp = np.r_[before, np.where(differ.any(1), differ.argmax(1), k)]
        last = batch.num_rows - 1
        if last:
            yield known(batch.slice(0, last), lcp[:-1], (lcp[:-1] == k) | (lcp[:-1] < 0) | (lcp[1:] == k))
        held, before = batch.slice(last), lcp[-1]
    if held is not None:
        yield known(held, np.array([before]), np.array([True]))


_ENTRY = "suffix binary, r long, doc_id long, key int, start int, n int"
_ARRAY = _ENTRY + ", lcp int, again boolean"
_ORDER = ["suffix", "doc_id", "key", "start"]


class SuffixIndex:
    """The family of suffix arrays, in tables below a path that all executors share. A level holds 2**i batches.

    A batch comes as the sorted suffixes of each of its tasks. Together with all levels that it makes as
    large as itself, it is merged at once into the next level: their suffixes in one order, with what neighbours have in
    common, which shows all repeats among them. With larger levels it is merge-joined by hashes of suffixes, and those that both
    have are noted. Levels are read in their order, so each task of a merge gets sorted runs, one for each file that its range
    lies in, and its sort only merges these. Merged levels are deleted. An index that was left can be opened again at its path; a table
    whose writing broke off doesn't count.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, key_bytes: int = KEY_BYTES):
        self.spark, self.path, self.length, self.key_bytes = spark, path, length, key_bytes
        found = [(*map(int, m.groups()), name) for name in written(spark, path) if (m := re.fullmatch(r"level-(\d+)-(\d+)-\w+", name))]
        held = [x for x in found if not any(y[0] <= x[0] and x[1] <= y[1] and y[2] != x[2] and (y[:2] != x[:2] or y[2].endswith("array")) for y in found)]
        #: (first batch, last batch, name of the table)
        self.levels: list[tuple[int, int, str]] = sorted(held)
        self.notes = [name for name in written(spark, path) if name.startswith("notes-")]

    def _read(self, schema: str, *names: str) -> DataFrame:
        """Tables of the index; one without rows may have no file to tell its columns."""
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _merge(self, levels: list[tuple[int, int, str]]) -> tuple[int, int, str]:
        """One suffix array of several levels, which go."""
        first, last = min(x[0] for x in levels), max(x[1] for x in levels)
        name = f"level-{first}-{last}-array"
        entries = self._read(_ENTRY, *[x[2] for x in levels])
        merged = entries.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
        merged.mapInArrow(lambda b, k=self.key_bytes: _common(b, k), _ARRAY).write.parquet(f"{self.path}/{name}", compression="zstd")
        for x in levels:
            discard(self.spark, f"{self.path}/{x[2]}")
        return first, last, name

    def add(self, rows: DataFrame) -> None:
        """Adds a batch of rows (doc_id, key int, text)."""
        n = self.levels[-1][1] + 1 if self.levels else 0
        batch = (n, n, f"level-{n}-{n}-runs")
        length, k = self.length, self.key_bytes
        entries = rows.select("doc_id", "key", "text").mapInArrow(lambda b: _entries(b, length, k), _ENTRY)
        entries.sortWithinPartitions(*_ORDER).write.parquet(f"{self.path}/{batch[2]}", compression="zstd")
        like, count = [batch], 1
        while self.levels and self.levels[-1][1] - self.levels[-1][0] + 1 == count:
            like.append(self.levels.pop())
            count *= 2
        if self.levels:
            suffixes = self._hashes(batch[2])
            both = [suffixes.join(self._hashes(x[2]), "s", "left_semi") for x in self.levels]
            functools.reduce(DataFrame.union, both).distinct().write.parquet(f"{self.path}/notes-{n}")
            self.notes.append(f"notes-{n}")
        self.levels.append(self._merge(like) if len(like) > 1 else batch)

    def noted(self) -> DataFrame:
        """Hashes (s) of the suffixes that scans of batches found in larger levels."""
        return self._read("s long", *self.notes).distinct()

    def _hashes(self, level: str) -> DataFrame:
        """The distinct suffixes of a level as 64 bits, a fifth of their bytes: equal hashes of others only add candidates, whose bytes are
        compared later. An array has a suffix again where it has all bytes in common with the one before, so it needs no grouping."""
        if level.endswith("array"):
            entries = self._read("suffix binary, lcp int", level).where(F.coalesce(F.col("lcp") < self.key_bytes, F.lit(True)))
            return entries.select(F.xxhash64("suffix").alias("s"))
        return self._read("suffix binary", level).select(F.xxhash64("suffix").alias("s")).distinct()

    def repeated(self) -> DataFrame:
        """All entries whose suffix may occur more than once: all that do, and the ends of partitions."""
        self.levels = [self._merge([x]) if x[2].endswith("runs") else x for x in self.levels]
        if not self.levels:
            return self.spark.createDataFrame([], _ENTRY)
        entries = self._read(_ARRAY, *[x[2] for x in self.levels])
        found = entries.where("again")
        if self.notes:
            found = found.unionByName(entries.where("not again").withColumn("s", F.xxhash64("suffix")).join(self.noted(), "s", "left_semi").drop("s"))
        return found.drop("lcp", "again")


def _runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of runs of windows, one row each."""
    names = ["g", "doc_id", "key", "start", "n", "parts", "once", "part", "bytes"]
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            rows = batch.slice(lo, 64)
            data, offsets = utf8(rows["text"])
            lists = rows["runs"]
            at, runs = lists.offsets.to_numpy(), lists.flatten()
            at = at - at[0]
            row = np.repeat(np.arange(rows.num_rows), np.diff(at))
            g, start, n, parts, once = (runs.field(c).to_numpy(zero_copy_only=False) for c in ("g", "start", "n", "parts", "once"))
            doc, key = rows["doc_id"].to_numpy()[row], rows["key"].to_numpy()[row]
            part = (mix(doc.view(np.uint64) * np.uint64(3) + start.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
            for s in range(0, len(row), 8192):
                e = min(s + 8192, len(row))
                sizes = n[s:e].astype(np.int64) + length - 1
                body = data[ragged(offsets[row[s:e]] + start[s:e], sizes)]
                binary = pa.BinaryArray.from_buffers(pa.binary(), e - s, [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([*(pa.array(c[s:e]) for c in (g, doc, key, start, n, parts, once, part)), binary], names)


def _equal(data: np.ndarray, p: np.ndarray, q: np.ndarray, length: int, most: int = 1 << 22) -> np.ndarray:
    """Whether the strings of that length at p and q have the same bytes. Neighbouring pairs at one distance share their comparison."""
    order = np.lexsort((p, q - p))
    at, far = p[order], (q - p)[order]
    first = np.flatnonzero(np.r_[True, (far[1:] != far[:-1]) | (at[1:] - at[:-1] > length)])
    last = np.r_[first[1:], len(at)] - 1
    sizes = at[last] - at[first] + length
    out = np.zeros(len(p), bool)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), most)) + lo)
        here = ragged(at[first[lo:hi]], sizes[lo:hi])
        differ = np.r_[0, np.cumsum(data[here] != data[here + np.repeat(far[first[lo:hi]], sizes[lo:hi])])]
        pairs = np.arange(first[lo], last[hi - 1] + 1)
        piece = np.repeat(np.arange(hi - lo), last[lo:hi] - first[lo:hi] + 1)
        start = np.r_[0, np.cumsum(sizes[lo:hi])][piece] + at[pairs] - at[first[lo:hi]][piece]
        out[order[pairs]] = differ[start + length] == differ[start]
        lo = hi
    return out


def _scan(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Windows that runs which occur once share with other runs of the same suffix, or hold twice; windows of equal hash are compared by their bytes.

    Rows (doc_id, key, start, stop): bytes to remove. For suffixes that are dealt to several parts also
    rows with g and 128 bits of hash, h and i: one for each distinct window, with alone where this part has it once."""
    table = table.combine_chunks()
    g, doc, key, start, n, parts, once = (table[c].to_numpy() for c in ("g", "doc_id", "key", "start", "n", "parts", "once"))
    n = n.astype(np.int64)
    column = table["bytes"].combine_chunks() if isinstance(table["bytes"], pa.ChunkedArray) else table["bytes"]
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    at = ragged(offsets[:-1] - offsets[0], n)
    run = np.repeat(np.arange(len(n)), n)
    place = start[run] + ragged(np.zeros(len(n), np.int64), n)
    h = mix(_window_hashes(data, length)[at] + g[run].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    same = (h[order][1:] == h[order][:-1]) & (g[run[order]][1:] == g[run[order]][:-1])
    i = np.flatnonzero(same)
    if len(i):
        same[i] = _equal(data, at[order[i]], at[order[i + 1]], length)
    again = np.zeros(len(h), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    hit = np.flatnonzero(again & once[run])
    names = ["doc_id", "key", "start", "stop", "g", "h", "i", "alone"]

    def found(r: np.ndarray, first: np.ndarray, last: np.ndarray, *more: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(key[r]), pa.array(place[first]), pa.array(place[last] + length), *more], names)

    if len(hit):
        cut = np.flatnonzero(np.r_[True, (run[hit][1:] != run[hit][:-1]) | (hit[1:] != hit[:-1] + 1)])
        first, last = hit[cut], hit[np.r_[cut[1:], len(hit)] - 1]
        yield found(run[first], first, last, *(pa.nulls(len(first), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.bool_())))
    one = np.zeros(len(h), bool)
    one[order[np.r_[True, ~same]]] = True
    one &= parts[run] > 1
    i = np.flatnonzero(one)
    if len(i):
        second = _window_hashes(data, length, _totals(data, 1))[at[i]]
        yield found(run[i], i, i, pa.array(g[run[i]]), pa.array(h[i].view(np.int64)), pa.array(second.view(np.int64)), pa.array(~again[i] & once[run[i]]))


def _clean(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            rows = batch.slice(lo, 256)
            data, offsets = utf8(rows["text"])
            removed, spans, kept = [], [], []
            for i, cuts in enumerate(rows["cuts"]):
                body = data[offsets[i] : offsets[i + 1]]
                if cuts.is_valid and len(cuts.values):
                    s, e = (cuts.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
                    o = np.argsort(s, kind="stable")
                    s, reach = s[o], np.maximum.accumulate(e[o])
                    new = np.r_[True, s[1:] > reach[:-1]]
                    s, e = s[new], reach[np.r_[np.flatnonzero(new)[1:], len(reach)] - 1]
                    gone = np.zeros(len(body), bool)
                    gone[ragged(s, e - s)] = True
                    body = body[~gone]
                    removed.append(int((e - s).sum()))
                    spans.append(len(s))
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(body.tobytes())
            out = [rows["doc_id"], pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in kept])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary())] * texts, names + ["kept"] * texts)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, key_bytes: int = KEY_BYTES, batches: int = BATCHES, group_rows: int = GROUP_ROWS, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of each row with an id.

    Every byte that a string of `length` bytes covers which also starts anywhere else goes, in all
    its occurrences; strings overlap, lie within one text and are judged on the input. Null text
    counts as empty, and long texts count whole. A row that repeats another's text repeats its strings, so both go. Rows that
    repeat an id are kept apart by their texts. Other columns aren't looked at.

    A run that occurs again with all its bytes (its suffix, their number and 64 bits of hash) goes whole, by a count. Of the
    other runs with a repeated suffix, each distinct one travels once, as bytes, to where they are compared;
    those of a suffix with many distinct runs are dealt to several tasks, which pass on each distinct window once, to be
    counted by 128 bits of hash. Positions come back by document.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.hash("text"))
    spark = docs.sparkSession
    path = scratch(spark, "suffixes")
    index = SuffixIndex(spark, f"{path}/index", length, key_bytes)
    for i in range(batches):
        index.add(rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(batches)) == i))
    cuts = repeated_bytes(rows, index, path, group_rows)
    discard(spark, index.path)
    cuts = cuts.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return rows.join(cuts, ["doc_id", "key"], "left").select("doc_id", "text", "cuts").mapInArrow(lambda b: _clean(b, texts), out)


def repeated_bytes(rows: DataFrame, index: SuffixIndex, path: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, key, start, stop): bytes of the rows (doc_id, key, text) of an index that strings of its length cover which
    start anywhere else in it. They may overlap, and lie in a table below path."""
    spark, length = rows.sparkSession, index.length
    found = index.repeated()
    contents = stored(found.groupBy("suffix", "r", "n").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "key", "start")).alias("at")), f"{path}/contents")
    many = contents.groupBy("suffix").count().where("count > 1").select("suffix", F.ceil(F.col("count") / group_rows).cast("int").alias("parts"))
    picked = contents.join(many, "suffix").select(F.xxhash64("suffix").alias("g"), "n", "parts", "at.*", (F.col("c") == 1).alias("once"))
    by_doc = picked.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("g", "start", "n", "parts", "once"))).alias("runs"))
    runs = rows.join(by_doc, ["doc_id", "key"]).select("doc_id", "key", "text", "runs")
    runs = runs.mapInArrow(lambda b: _runs(b, length), "g long, doc_id long, key int, start int, n int, parts int, once boolean, part int, bytes binary")
    dealt = runs.repartition("g", "part").sortWithinPartitions("g", "part")
    schema = "doc_id long, key int, start long, stop long, g long, h long, i long, alone boolean"
    scanned = settled(dealt.mapInArrow(lambda b: whole_groups(b, ["g", "part"], lambda t: _scan(t, length), group_rows, "n", 1 << 19), schema))
    windows = scanned.where("g is not null")
    again = windows.groupBy("g", "h", "i").count().where("count > 1").select("g", "h", "i")
    twice = contents.where("c > 1").select("suffix", "r", "n")
    whole = found.join(twice, ["suffix", "r", "n"], "left_semi").select("doc_id", "key", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n") + length - 1).cast("long").alias("stop"))
    shared = windows.where("alone").join(again, ["g", "h", "i"]).select("doc_id", "key", "start", "stop")
    cuts = whole.unionByName(scanned.where("g is null").select("doc_id", "key", "start", "stop")).unionByName(shared)
    cuts = stored(cuts, f"{path}/cuts")
    discard(spark, f"{path}/contents")
    return cuts
