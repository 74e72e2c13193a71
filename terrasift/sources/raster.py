"""Single-band rasters (TIFF and BigTIFF, in strips or tiles) as a Python data source, with the places of GeoTIFF.

spark.read.format("raster").load(path) gives cells (tile, row, col, v); a task reads a range of strips or tiles, so that one
file is shared out over tasks. Option headers=true gives a row per file without reading any. df.write.format("raster")
writes a file for each tile and band as its rows come by, a strip at a time. The file's missing value is NULL here.

Options: band (files are named tile_band.tif; without it the tile is the whole name), pattern, recursive, blocks (strips or tiles of a task);
for writing nodata, compress (deflate, zstd or none) and strip (rows of a strip).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from ..operators.tiles import with_tiles
from .files import Staged, Written, files_below, open_uri

SCHEMA = "tile string, row int, col int, v double"
HEADERS = "tile string, height int, width int, resolution double, west double, north double, nodata double, dtype string, crs string"
#: Tags, types, compressions and geo keys: fixed by the public specifications of TIFF, BigTIFF and GeoTIFF.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
_NONE, _DEFLATE, _OLD_DEFLATE, _ZSTD = 1, 8, 32946, 50000
_KINDS = {1: "u", 2: "i", 3: "f"}
_CODE_KEYS, _OWN = (3072, 2048), 32767
#: Bytes of cells above which a file gets 8-byte offsets.
BIG = 1 << 31


def read_tags(path: str) -> tuple[dict[int, tuple], str]:
    """The tags of the first image of a file and its byte order, without reading cells."""
    fs, inner = open_uri(path)
    with fs.open_input_file(inner) as f:
        head = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else 0
        if magic not in (42, 43):
            raise ValueError(f"{path}: not a TIFF file")
        big = magic == 43
        at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
        count_of, entry_of, place = ("Q", "HHQ8s", 8) if big else ("H", "HHI4s", 4)
        n = struct.unpack(order + count_of, f.read_at(struct.calcsize("<" + count_of), at))[0]
        size = struct.calcsize("<" + entry_of)
        raw = f.read_at(n * size, at + struct.calcsize("<" + count_of))
        tags = {}
        for i in range(n):
            tag, kind, count, value = struct.unpack_from(order + entry_of, raw, i * size)
            if kind not in _TYPES:
                continue
            length = count * struct.calcsize("<" + _TYPES[kind])
            body = value[:length] if length <= place else f.read_at(length, struct.unpack(order + ("Q" if big else "I"), value)[0])
            tags[tag] = (body.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(order + count * _TYPES[kind], body)
    return tags, order


def read_header(path: str) -> dict:
    """Size, place, missing value and how cells are stored."""
    t, order = read_tags(path)
    one = lambda tag, default=None: t.get(tag, (default,))[0]
    width, height = one(WIDTH), one(HEIGHT)
    scale, tie = t.get(SCALE, (1.0, 1.0, 0.0)), t.get(TIEPOINT, (0.0,) * 6)
    kind, bits = _KINDS.get(one(FORMAT, 1)), one(BITS, 1)
    if kind is None or bits % 8:
        raise ValueError(f"{path}: cells of that kind aren't read")
    tiled = TILES in t
    across = one(TILE_WIDTH) if tiled else width
    down = one(TILE_HEIGHT) if tiled else min(one(STRIP_ROWS, height), height)
    keys = np.array(t.get(GEO_KEYS, ()), int)
    keys = {k: v for k, where, n, v in keys[4 : 4 + 4 * keys[3]].reshape(-1, 4).tolist() if where == 0 and n == 1} if len(keys) >= 4 else {}
    code = next((keys[k] for k in _CODE_KEYS if keys.get(k, _OWN) != _OWN), None)
    try:
        nodata = float(one(NODATA, "nan"))
    except ValueError:
        nodata = float("nan")
    return {
        "width": width, "height": height, "resolution": float(scale[0]), "west": tie[3] - tie[0] * scale[0], "north": tie[4] + tie[1] * scale[1], "nodata": nodata,
        "dtype": f"{kind}{bits // 8}", "order": order, "crs": f"EPSG:{code}" if code else None, "across": across, "down": down, "tiled": tiled, "samples": one(SAMPLES, 1), "planar": one(PLANAR, 1),
        "compression": one(COMPRESSION, 1), "predictor": one(PREDICTOR, 1), "offsets": t[TILES if tiled else STRIPS], "sizes": t[TILE_BYTES if tiled else STRIP_BYTES],
    }


def _unpacked(raw: bytes, compression: int) -> bytes:
    if compression == _NONE:
        return raw
    if compression in (_DEFLATE, _OLD_DEFLATE):
        return zlib.decompress(raw)
    if compression == _ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise ValueError(f"compression {compression} isn't read")


def decode_block(raw: bytes, h: dict, rows: int) -> np.ndarray:
    """The cells of a strip or tile, of the first sample."""
    data = np.frombuffer(_unpacked(raw, h["compression"]), np.uint8)
    wide, n = h["across"] * (h["samples"] if h["planar"] == 1 else 1), int(h["dtype"][1:])
    data = data[: rows * wide * n].reshape(rows, wide * n)
    if h["predictor"] == 3:  # differences of bytes, the highest bytes of all cells first
        step = h["samples"] if h["planar"] == 1 else 1
        data = np.cumsum(data.reshape(rows, -1, step), axis=1, dtype=np.uint8).reshape(rows, n, wide).transpose(0, 2, 1)
        cells = np.ascontiguousarray(data).view(f">{h['dtype']}")[:, :, 0]
    else:
        cells = data.view(h["order"] + h["dtype"])
        if h["predictor"] == 2:
            step = h["samples"] if h["planar"] == 1 else 1
            whole = np.ascontiguousarray(cells).view(h["order"] + f"u{n}").astype(f"u{n}").reshape(rows, -1, step)
            cells = np.cumsum(whole, axis=1, dtype=f"u{n}").reshape(rows, wide).view(h["dtype"])
    return cells[:, :: h["samples"]] if h["planar"] == 1 else cells


def encode_block(cells: np.ndarray, compress: str) -> bytes:
    """32-bit cells as a strip: differences of bytes, the highest first, then packed."""
    if compress == "none":
        return cells.astype("<f4").tobytes()
    rows, wide = cells.shape
    data = cells.astype(">f4").view(np.uint8).reshape(rows, wide, 4).transpose(0, 2, 1).reshape(rows, -1)
    data = np.concatenate([data[:, :1], data[:, 1:] - data[:, :-1]], axis=1).tobytes()
    if compress == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    return zlib.compress(data, 6)


class _Blocks(InputPartition):
    def __init__(self, path: str, first: int, n: int):
        self.path, self.first, self.n = path, first, n


def _tile(path: str, band: str | None) -> str:
    name = path.rpartition("/")[2].rpartition(".")[0]
    return name.removesuffix(f"_{band}") if band else name


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.band, self.blocks = options["path"], options.get("band"), max(1, int(options.get("blocks", 64)))
        self.pattern = options.get("pattern", f"*_{self.band}.tif" if self.band else "*.tif,*.tiff")
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.headers = str(options.get("headers", "false")).lower() == "true"

    def partitions(self) -> list[_Blocks]:
        files = files_below(self.path, self.pattern, self.recursive)
        if self.headers:
            return [_Blocks(f, 0, 0) for f in files]
        out = []
        for f in files:
            n = len(read_header(f)["offsets"])
            out += [_Blocks(f, i, min(self.blocks, n - i)) for i in range(0, n, self.blocks)]
        return out

    def read(self, part: _Blocks) -> Iterator:
        h, tile = read_header(part.path), _tile(part.path, self.band)
        if self.headers:
            yield (tile, h["height"], h["width"], h["resolution"], h["west"], h["north"], None if np.isnan(h["nodata"]) else h["nodata"], h["dtype"], h["crs"])
            return
        side = -(-h["width"] // h["across"])
        per_band = side * -(-h["height"] // h["down"])
        fs, inner = open_uri(part.path)
        with fs.open_input_file(inner) as f:
            for i in range(part.first, min(part.first + part.n, per_band)):  # blocks of further bands come after those of the first
                top, left = i // side * h["down"], i % side * h["across"]
                rows = h["down"] if h["tiled"] else min(h["down"], h["height"] - top)  # the last strip may be lower, tiles are all alike
                raw = f.read_at(h["sizes"][i], h["offsets"][i])
                if not raw:  # a block that was never written is missing as a whole
                    cells = np.full((rows, h["across"]), h["nodata"])
                else:
                    cells = decode_block(raw, h, rows)
                cells = cells[: h["height"] - top, : h["width"] - left].astype(np.float64)
                ok = np.isfinite(cells) & (cells != h["nodata"])
                r, c = np.indices(cells.shape, np.int32)
                columns = [pa.array([tile] * cells.size), pa.array((r + top).astype(np.int32).ravel()), pa.array((c + left).astype(np.int32).ravel()), pa.array(cells.ravel(), mask=~ok.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["tile", "row", "col", "v"])


class _File:
    """A raster that is written from its first row to its last, a strip at a time; the tags come at the end."""

    def __init__(self, sink, height: int, width: int, strip: int, nodata: float, compress: str, place: tuple[float, float, float]):
        self.sink, self.height, self.width, self.strip, self.nodata, self.compress, self.place = sink, height, width, strip, nodata, compress, place
        self.big = height * width * 4 >= BIG
        self.at, self.offsets, self.sizes, self.next = 0, [], [], 0
        self._write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if self.big else struct.pack("<2sHI", b"II", 42, 0))
        self.rows = np.full((min(strip, height), width), nodata, np.float32)

    def _write(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def put(self, row: np.ndarray, col: np.ndarray, v: np.ndarray) -> None:
        """Cells in the order of their rows."""
        lo = 0
        while lo < len(row):
            end = self.next + len(self.rows)
            hi = int(np.searchsorted(row, end))
            self.rows[row[lo:hi] - self.next, col[lo:hi]] = v[lo:hi]
            if hi < len(row):
                self._strip()
            lo = hi

    def _strip(self) -> None:
        raw = encode_block(self.rows, self.compress)
        self.offsets.append(self.at)
        self.sizes.append(len(raw))
        self._write(raw)
        self.next += len(self.rows)
        self.rows = np.full((min(self.strip, self.height - self.next), self.width), self.nodata, np.float32)

    def close(self) -> int:
        """The place of the tags, which the start of the file has to name."""
        while self.next < self.height:
            self._strip()
        west, north, resolution = self.place
        text = repr(self.nodata).encode() + b"\0"
        kind = 16 if self.big else 4
        tags = [
            (WIDTH, 4, [self.width]), (HEIGHT, 4, [self.height]), (BITS, 3, [32]), (COMPRESSION, 3, [{"none": _NONE, "deflate": _DEFLATE, "zstd": _ZSTD}[self.compress]]),
            (PHOTOMETRIC, 3, [1]), (STRIPS, kind, self.offsets), (SAMPLES, 3, [1]), (STRIP_ROWS, 4, [self.strip]), (STRIP_BYTES, kind, self.sizes), (PLANAR, 3, [1]),
            (PREDICTOR, 3, [1 if self.compress == "none" else 3]), (FORMAT, 3, [3]), (SCALE, 12, [resolution, resolution, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, west, north, 0.0]),
            (NODATA, 2, text),
        ]
        small, entry = (8, "<HHQ8s") if self.big else (4, "<HHI4s")
        start = self.at
        after = start + (8 + 20 * len(tags) + 8 if self.big else 2 + 12 * len(tags) + 4)
        table, bodies = struct.pack("<Q" if self.big else "<H", len(tags)), b""
        for tag, type_, values in tags:
            body = values if type_ == 2 else struct.pack(f"<{len(values)}{_TYPES[type_]}", *values)
            if len(body) > small:
                where = after + len(bodies)
                bodies += body + b"\0" * (-len(body) % 8)
                body = struct.pack("<Q" if self.big else "<I", where)
            table += struct.pack(entry, tag, type_, len(values), body)
        self._write(table + bytes(8 if self.big else 4) + bodies)
        return start


class _Writer(Staged, DataSourceArrowWriter):
    """Cells come sorted by tile, band, row and col, with the size and place of their tile. As a file's start names the place of its tags, a
    finished file is copied with that place filled in."""

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options["path"], overwrite, "*.tif")
        self.nodata, self.compress, self.strip = float(options.get("nodata", -9999.0)), options.get("compress", "deflate"), max(1, int(options.get("strip", 64)))
        if self.compress not in ("deflate", "zstd", "none"):
            raise ValueError(f"compress is deflate, zstd or none, not {self.compress!r}")

    def public(self, name: str) -> str:
        return name.partition("/")[2]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from uuid import uuid4

        key, file, written, folder = None, None, [], uuid4().hex

        def finish() -> None:
            if file is None:
                return
            tags = file.close()
            file.sink.close()
            fs, inner = open_uri(f"{self.staging}/{folder}/{key[0]}_{key[1]}.part")
            head = struct.pack("<Q", tags) if file.big else struct.pack("<I", tags)
            with fs.open_input_stream(inner) as source, self.staged(f"{folder}/{key[0]}_{key[1]}.tif") as sink:
                sink.write(source.read(8 if file.big else 4) + head)
                source.read(len(head))
                while chunk := source.read(1 << 22):
                    sink.write(chunk)
            fs.delete_file(inner)
            written.append(f"{folder}/{key[0]}_{key[1]}.tif")

        for b in batches:
            if not b.num_rows:
                continue
            tile, band = (np.array([str(x) for x in b[c].to_pylist()], object) for c in ("tile", "band"))
            row, col, v = (b[c].to_numpy(zero_copy_only=False) for c in ("row", "col", "v"))
            cuts = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (band[1:] != band[:-1])])
            for lo, hi in zip(cuts, np.r_[cuts[1:], b.num_rows], strict=True):
                if (tile[lo], band[lo]) != key:
                    finish()
                    key = (tile[lo], band[lo])
                    height, width, *place = (b[c][int(lo)].as_py() for c in ("height", "width", "west", "north", "resolution"))
                    file = _File(self.staged(f"{folder}/{key[0]}_{key[1]}.part"), height, width, self.strip, self.nodata, self.compress, tuple(place))
                file.put(row[lo:hi].astype(np.int64), col[lo:hi].astype(np.int64), np.where(np.isfinite(v[lo:hi].astype(float)), v[lo:hi].astype(float), self.nodata))
        finish()
        return Written(written)


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return HEADERS if str(self.options.get("headers", "false")).lower() == "true" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def write_rasters(cells: DataFrame, grids: DataFrame, path: str, bands: list[str], resolution: float = 1.0, mode: str = "append", **options: str) -> None:
    """A file tile_band.tif for each tile and band below path. A tile's band is one file and so one task's, which holds a strip of it."""
    spark = cells.sparkSession
    spark.dataSource.register(RasterSource)
    sized = with_tiles(cells.select("tile", "row", "col", *[F.col(b).cast("double").alias(b) for b in bands]), grids.select("tile", "height", "width", "west", "north"))
    keys = ["tile", "row", "col", "height", "width", "west", "north"]
    rows = sized.unpivot(keys, bands, "band", "v").withColumn("resolution", F.lit(float(resolution)))
    dealt = rows.repartition("tile", "band").sortWithinPartitions("tile", "band", "row", "col")
    dealt.write.format("raster").options(**options).mode(mode).save(path)


def read_rasters(spark: SparkSession, path: str, band: str | None = None, headers: bool = False, **options: str) -> DataFrame:
    """Cells (tile, row, col, v) of a band's files, or a row per file."""
    spark.dataSource.register(RasterSource)
    named = {"band": band} if band else {}
    return spark.read.format("raster").options(headers=str(headers).lower(), **named, **options).load(path)
