"""LAS 1.2 point files (formats 0 to 3) as a Python data source: batch and stream reader, and writer.

spark.read.format("las").load(path) reads ranges of records, so that one file is shared out over
tasks; option headers=true gives one row per file without reading points. spark.readStream.format("las") takes files in
the order in which they arrive, with offsets of a file and a record. df.write.format("las").mode("append").save(path)
writes files that are listed only once all tasks are done. Compressed files (.laz) are refused.

Options: chunk_size (records of a task), pattern (names of files, with commas between them), recursive, records_per_batch
(of a stream, from its second batch on); scale and file_points for writing.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import Staged, Written, files_below, infos, open_uri, same_store

SCHEMA = "tile string, x double, y double, z double, intensity int, return_num int, num_returns int, cls int"
HEADERS = "tile string, point_count long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, crs string"
#: Bytes of a record of each point format; the first 20 bytes are alike in all. Fixed by the public LAS 1.2 specification.
RECORD_BYTES = {0: 20, 1: 28, 2: 26, 3: 34}
_HEAD = struct.Struct("<4sHH16sBB32s32sHHHIIBHI5I3d3d6d")
#: A variable-length record: reserved, user, kind, bytes that follow its description of 32 bytes. Kinds, geo keys and the code for "user-defined", fixed by the public specifications of LAS and GeoTIFF.
_RECORD = struct.Struct("<H16sHH")
_WKT, _GEO_KEYS = 2112, 34735
_CODE_KEYS, _OWN = (3072, 2048), 32767
_POINT = [("xyz", "<i4", 3), ("intensity", "<u2"), ("flags", "u1"), ("cls", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]


def read_header(path: str) -> dict:
    """Number of points, where they start, scales, offsets and bounds."""
    if path.lower().endswith(".laz"):
        raise ValueError(f"{path}: compressed points need a LAZ codec")
    fs, inner = open_uri(path)
    with fs.open_input_file(inner) as f:
        raw = f.read_at(_HEAD.size, 0)
        h = _HEAD.unpack(raw) if len(raw) == _HEAD.size else (b"",) * 33
        if h[0] != b"LASF" or h[13] not in RECORD_BYTES:
            raise ValueError(f"{path}: not a LAS file of point format 0 to 3")
        about = f.read_at(h[11] - h[10], h[10])
    x1, x0, y1, y0, z1, z0 = h[27:33]
    return {"crs": coordinate_system(about, h[12]), "start": h[11], "bytes": h[14], "count": h[15], "scale": h[21:24], "offset": h[24:27], "min": (x0, y0, z0), "max": (x1, y1, z1)}


def coordinate_system(records: bytes, count: int) -> str | None:
    """The coordinate system that the variable-length records between header and points name: the text of a WKT record, or the EPSG
    code of the projected, else the geographic system of the geo keys. None if there is none, or if records are broken."""
    wkt, codes, at = None, {}, 0
    try:
        for _ in range(count):
            _, user, kind, size = _RECORD.unpack_from(records, at)
            body = records[at + _RECORD.size + 32 :][:size]
            if len(body) < size:
                return None
            at += _RECORD.size + 32 + size
            if user.rstrip(b"\0") != b"LASF_Projection":
                continue
            if kind == _WKT:
                wkt = body.rstrip(b"\0").decode()
            elif kind == _GEO_KEYS:
                n = struct.unpack_from("<4H", body)[3]
                keys = np.frombuffer(body, "<u2", 4 * n, 8).reshape(n, 4).tolist()
                codes |= {key: value for key, where, length, value in keys if where == 0 and length == 1}
    except (struct.error, ValueError):  # UnicodeDecodeError is a ValueError
        return None
    code = next((codes[k] for k in _CODE_KEYS if codes.get(k, _OWN) != _OWN), None)
    return wkt or (f"EPSG:{code}" if code else None)


def _tile(path: str) -> str:
    """The name of a file without its end, and without what the writer adds to keep files apart."""
    return re.sub(r"__[0-9a-f]{32}$", "", path.rpartition("/")[2].rpartition(".")[0])


class _Range(InputPartition):
    def __init__(self, path: str, first: int, n: int):
        self.path, self.first, self.n = path, first, n


def _ranges(path: str, first: int, end: int, chunk: int) -> list[_Range]:
    return [_Range(path, a, min(chunk, end - a)) for a in range(first, end, chunk)]


class _Points:
    """What batch and stream reader have in common."""

    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], max(1, int(options.get("chunk_size", 1_000_000)))
        self.listing = options.get("pattern", "*.las,*.laz"), str(options.get("recursive", "false")).lower() == "true"
        self.headers = str(options.get("headers", "false")).lower() == "true"
        self.most = int(options.get("records_per_batch", 0))

    def read(self, part: _Range) -> Iterator:
        h, tile = read_header(part.path), _tile(part.path)
        if self.headers:
            yield (tile, h["count"], *h["min"], *h["max"], h["crs"])
            return
        fs, inner = open_uri(part.path)
        with fs.open_input_file(inner) as f:
            for lo in range(part.first, part.first + part.n, 65536):
                n = min(65536, part.first + part.n - lo)
                raw = np.frombuffer(f.read_at(n * h["bytes"], h["start"] + lo * h["bytes"]), np.uint8).reshape(n, h["bytes"])
                p = np.ascontiguousarray(raw[:, :20]).view(np.dtype(_POINT))[:, 0]
                xyz = p["xyz"] * np.array(h["scale"]) + np.array(h["offset"])
                cols = [pa.array([tile] * n), *(pa.array(xyz[:, k]) for k in range(3)), *(pa.array(v.astype(np.int32)) for v in (p["intensity"], p["flags"] & 7, p["flags"] >> 3 & 7, p["cls"]))]
                yield pa.RecordBatch.from_arrays(cols, ["tile", "x", "y", "z", "intensity", "return_num", "num_returns", "cls"])


class _Reader(_Points, DataSourceReader):
    def partitions(self) -> list[_Range]:
        files = files_below(self.path, *self.listing)
        if self.headers:
            return [_Range(f, 0, 0) for f in files]
        return [x for f in files for x in _ranges(f, 0, read_header(f)["count"], self.chunk)]


class _Stream(_Points, DataSourceStreamReader):
    """Files in the order of their times, then names. An offset names a file and how many of its records are read, so it stays small
    however many files there were; all before it are read. A file has to be complete when it appears (as the writer's are), and not
    to be older than those that were read."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.at: dict | None = None  # where the last planned batch ends; Spark doesn't tell before it asks for the first end
        self.asked = False  # what is planned before that is an old batch once more, and a run over all that is available asks only once

    def initialOffset(self) -> dict:
        return {"time": 0, "file": "", "record": 0}

    def _after(self, offset: dict) -> list[tuple[int, str]]:
        """(time, file) from that of the offset on."""
        found = sorted((f.mtime_ns, same_store(self.path, f.path)) for f in infos(self.path, *self.listing))
        return [x for x in found if x >= (offset["time"], offset["file"])]

    def latestOffset(self) -> dict:
        """As far as records_per_batch allows; without a limit, and in the first batch after a start, all that is there."""
        begin, self.asked = self.at or self.initialOffset(), True
        files = self._after(begin)
        if self.at is None or not self.most:
            return {"time": files[-1][0], "file": files[-1][1], "record": read_header(files[-1][1])["count"]} if files else begin
        end, left = begin, self.most
        for time, file in files:
            count = read_header(file)["count"]
            first = begin["record"] if (time, file) == (begin["time"], begin["file"]) else 0
            end = {"time": time, "file": file, "record": min(count, first + left)}
            left -= end["record"] - first
            if left <= 0:
                break
        return end

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        self.at = end if self.asked else None
        out = []
        for time, file in self._after(start):
            if (time, file) > (end["time"], end["file"]):
                break
            last = end["record"] if (time, file) == (end["time"], end["file"]) else read_header(file)["count"]
            out += _ranges(file, start["record"] if (time, file) == (start["time"], start["file"]) else 0, last, self.chunk)
        return out

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class _Writer(Staged, DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options["path"], overwrite, "*.las")
        self.scale, self.most = float(options.get("scale", 0.001)), max(1, int(options.get("file_points", 1_000_000)))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        written: list[str] = []

        def flush(tile: str) -> None:
            rows = np.concatenate(held.pop(tile))
            del sizes[tile]
            for lo in range(0, len(rows), self.most):
                part = rows[lo : lo + self.most]
                name = f"{tile}__{uuid.uuid4().hex}.las"
                with self.staged(name) as f:
                    f.write(las_bytes(part[:, :3], *(part[:, k].astype(np.int64) for k in (3, 4, 5, 6)), scale=self.scale))
                written.append(name)

        for b in batches:
            if not b.num_rows:
                continue
            given = dict(zip(b.schema.names, b.columns, strict=True))
            column = lambda c, default: given[c].to_numpy(zero_copy_only=False).astype(float) if c in given else np.full(b.num_rows, default)  # noqa: B023, E731
            rows = np.column_stack([column(c, d) for c, d in (("x", 0), ("y", 0), ("z", 0), ("intensity", 0), ("return_num", 1), ("num_returns", 1), ("cls", 2))])
            tiles = np.array([str(t) for t in given["tile"].to_pylist()], object)
            for t in dict.fromkeys(tiles):
                held.setdefault(t, []).append(rows[tiles == t])
                sizes[t] = sizes.get(t, 0) + len(held[t][-1])
            while sizes and sum(sizes.values()) >= 2 * self.most:
                flush(max(sizes, key=sizes.get))
        for t in list(held):
            flush(t)
        return Written(written)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return HEADERS if str(self.options.get("headers", "false")).lower() == "true" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        missing = {"tile", "x", "y", "z"} - {f.name for f in schema.fields}
        if missing:
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
        return _Writer(self.options, overwrite)


def las_bytes(xyz: np.ndarray, intensity=0, returns=1, returned=1, cls=2, scale: float = 0.001) -> bytes:
    """One file of point format 0: coordinates are rounded to the scale, offsets are the minima."""
    n = len(xyz)
    low, high = (xyz.min(axis=0), xyz.max(axis=0)) if n else (np.zeros(3), np.zeros(3))
    p = np.zeros(n, np.dtype(_POINT))
    p["xyz"] = np.round((xyz - low) / scale)
    p["intensity"], p["cls"], p["flags"] = intensity, cls, np.asarray(returns) | np.asarray(returned) << 3
    bounds = [v for pair in zip(high, low, strict=True) for v in pair]
    return _HEAD.pack(b"LASF", 0, 0, b"", 1, 2, b"", b"terrasift", 1, 2026, _HEAD.size, _HEAD.size, 0, 0, 20, n, n, 0, 0, 0, 0, scale, scale, scale, *low, *bounds) + p.tobytes()


def write_las(points: DataFrame, path: str, file_points: int = 1_000_000, scale: float = 0.001, mode: str = "append") -> DataFrame:
    """Writes (tile, x, y, z, and intensity, return_num, num_returns, cls if they are there) as LAS files of bounded size below path; returns
    the headers of all files there. mode: append, or overwrite, which removes the files there once the new ones are in place."""
    spark = points.sparkSession
    spark.dataSource.register(LasSource)
    more = [c for c in ("intensity", "return_num", "num_returns", "cls") if c in points.columns]
    rows = points.select(F.col("tile").cast("string").alias("tile"), *[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.col(c).cast("int").alias(c) for c in more])
    # a place with more points than Spark gives one task is shared out, so that no task has all points of a tile
    placed = rows.select("*", F.floor(F.col("x") / 256).alias("_bx"), F.floor(F.col("y") / 256).alias("_by"))
    dealt = placed.hint("rebalance", "tile", "_bx", "_by").drop("_bx", "_by")
    dealt.write.format("las").option("file_points", file_points).option("scale", scale).mode(mode).save(path)
    return spark.read.format("las").option("headers", "true").load(path)
