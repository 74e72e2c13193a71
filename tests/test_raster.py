"""Raster files: round trips, files made here byte by byte in other layouts, and headers without cells."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.sources import raster


def made(cells, order="<", big=False, tile=None, strip=5, compression=1, predictor=1, nodata=None, samples=1, keys=()):
    """A file by the specification, written in plain loops: tags first, then blocks."""
    height, width = cells.shape
    kind, n = {"f": 3, "i": 2, "u": 1}[cells.dtype.kind], cells.dtype.itemsize
    down, across = tile or (strip, width)
    blocks = []
    for top in range(0, height, down):
        for left in range(0, width, across):
            rows = down if tile else min(down, height - top)
            block = np.zeros((rows, across), cells.dtype)
            part = cells[top : top + rows, left : left + across]
            block[: part.shape[0], : part.shape[1]] = part
            block = np.repeat(block, samples, axis=1)
            raw = b""
            for line in block:
                if predictor == 3:
                    plain = [struct.pack({4: ">f", 8: ">d"}[n], float(x)) for x in line]
                    body = [p[k] for k in range(n) for p in plain]
                    body = bytes([body[0]] + [(b - a) % 256 for a, b in zip(body, body[1:])])
                elif predictor == 2:
                    u = line.view(f"u{n}").astype(object)
                    u = [u[0]] + [(b - a) % (1 << 8 * n) for a, b in zip(u, u[1:])]
                    body = b"".join(int(x).to_bytes(n, "little" if order == "<" else "big") for x in u)
                else:
                    body = line.astype(line.dtype.newbyteorder(order)).tobytes()
                raw += body
            blocks.append(zlib.compress(raw) if compression in (8, 32946) else raw)
    tags = [(256, 3, [width]), (257, 3, [height]), (258, 3, [8 * n] * samples), (259, 3, [compression]), (277, 3, [samples]), (317, 3, [predictor]), (339, 3, [kind] * samples),
            (33550, 12, [2.0, 2.0, 0.0]), (33922, 12, [1.0, 2.0, 0.0, 100.0, 900.0, 0.0])]
    if keys:
        tags.append((34735, 3, [1, 1, 0, len(keys)] + [x for k in keys for x in k]))
    if nodata is not None:
        tags.append((42113, 2, nodata.encode() + b"\0"))
    where, sizes = (324, 325) if tile else (273, 279)
    tags += [(322, 3, [across]), (323, 3, [down])] if tile else [(278, 3, [strip])]
    wide, code = (8, "Q") if big else (4, "I")
    entry = 20 if big else 12
    count = len(tags) + 2
    head = struct.pack(order + "2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, 16) if big else struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8)
    after = len(head) + (8 if big else 2) + count * entry + wide
    types = {3: "H", 12: "d", 4: "I", 16: "Q"}
    extra = b""

    def place(kind, values):
        nonlocal extra
        body = values if kind == 2 else struct.pack(order + str(len(values)) + types[kind], *values)
        if len(body) > wide:
            extra += body
            return struct.pack(order + code, after + len(extra) - len(body))
        return body.ljust(wide, b"\0")

    entries = [(t, k, len(v), place(k, v)) for t, k, v in tags]
    offsets = [0] * len(blocks)
    lists = (len(blocks) * (8 if big else 4)) * 2 if len(blocks) * (8 if big else 4) > wide else 0
    at = after + len(extra) + lists
    for i, b in enumerate(blocks):
        offsets[i] = at
        at += len(b)
    long = 16 if big else 4
    entries += [(where, long, len(blocks), place(long, offsets)), (sizes, long, len(blocks), place(long, [len(b) for b in blocks]))]
    entries.sort()
    table = struct.pack(order + ("Q" if big else "H"), count) + b"".join(struct.pack(order + ("HHQ" if big else "HHI"), t, k, n_) + v for t, k, n_, v in entries)
    return head + table + bytes(wide) + extra + b"".join(blocks)


def grid_of(spark, path, shape, **options):
    out, seen = np.full(shape, np.nan), 0
    for r in raster.read_rasters(spark, f"file://{path}", **options).collect():
        seen += 1
        if r.v is not None:
            out[r.row, r.col] = r.v
    assert seen == shape[0] * shape[1]
    return out


LAYOUTS = [
    dict(), dict(order=">"), dict(big=True), dict(tile=(16, 16)), dict(tile=(16, 32), compression=8, predictor=3), dict(compression=8, predictor=3, strip=7),
    dict(compression=32946, order=">", predictor=3, big=True), dict(strip=100), dict(samples=3), dict(samples=2, strip=4, order=">"),
]


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_layouts(spark, tmp_path, layout):
    z = np.random.default_rng(1).normal(0, 900, (23, 37)).astype(np.float32)
    z[3:6, 2:30] = -9999
    z[0, 0] = np.nan
    (tmp_path / "a.tif").write_bytes(made(z, nodata="-9999", **layout))
    got = grid_of(spark, tmp_path, z.shape, blocks="2")
    assert np.array_equal(got, np.where(z == -9999, np.nan, z).astype(float), equal_nan=True)


@pytest.mark.parametrize("dtype", ["u1", "i2", "u2", "i4", "f8"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_kinds_of_cells(spark, tmp_path, dtype, predictor):
    z = np.random.default_rng(2).integers(0, 200, (11, 9)).astype(dtype)
    (tmp_path / "a.tif").write_bytes(made(z, compression=8, predictor=predictor if dtype != "f8" else 1, nodata="7"))
    assert np.array_equal(grid_of(spark, tmp_path, z.shape), np.where(z == 7, np.nan, z.astype(float)), equal_nan=True)


def test_headers_read_no_cells(spark, tmp_path):
    z = np.zeros((8, 5), np.float32)
    raw = made(z, nodata="-1.5", keys=((3072, 0, 1, 25832),), strip=8)
    (tmp_path / "t1_dem.tif").write_bytes(raw[: -z.nbytes])  # the cells are cut off
    (tmp_path / "t2_dem.tif").write_bytes(made(z.astype("i2"), nodata="none"))
    got = {r.tile: tuple(r)[1:] for r in raster.read_rasters(spark, f"file://{tmp_path}", band="dem", headers=True).collect()}
    assert got == {"t1": (8, 5, 2.0, 98.0, 904.0, -1.5, "f4", "EPSG:25832"), "t2": (8, 5, 2.0, 98.0, 904.0, None, "i2", None)}


@pytest.mark.parametrize("compress", ["deflate", "zstd", "none"])
@pytest.mark.parametrize("big", [False, True])
def test_round_trip(spark, tmp_path, monkeypatch, compress, big):
    if big:
        monkeypatch.setattr(raster, "BIG", 0)
    rng = np.random.default_rng(3)
    z = {"a": rng.normal(0, 50, (70, 13)).astype(np.float32), "b": rng.normal(0, 50, (1, 1)).astype(np.float32)}
    z["a"][rng.random(z["a"].shape) < 0.3] = np.nan
    z["a"][:20] = np.nan  # these cells aren't rows at all
    rows = [(t, int(r), int(c), None if np.isnan(v) else float(v), float(r)) for t, m in z.items() for (r, c), v in np.ndenumerate(m) if t == "b" or r >= 20]
    cells = spark.createDataFrame(rows, "tile string, row int, col int, z double, n double")
    grids = spark.createDataFrame([("a", 70, 13, 10.5, 99.5), ("b", 1, 1, 0.0, 0.0)], "tile string, height int, width int, west double, north double")
    raster.write_rasters(cells.repartition(5), grids, f"file://{tmp_path}/out", ["z", "n"], compress=compress, strip="8")
    assert sorted(os.listdir(tmp_path / "out")) == ["a_n.tif", "a_z.tif", "b_n.tif", "b_z.tif"]
    got = {(r.tile, r.row, r.col): r.v for r in raster.read_rasters(spark, f"file://{tmp_path}/out", "z", blocks="3").collect()}
    assert len(got) == 70 * 13 + 1
    for t, m in z.items():
        for (r, c), v in np.ndenumerate(m):
            assert got[t, r, c] is None if np.isnan(v) else got[t, r, c] == float(v)
    head = {r.tile: r for r in raster.read_rasters(spark, f"file://{tmp_path}/out", "n", headers=True).collect()}
    assert (head["a"].height, head["a"].width, head["a"].west, head["a"].north, head["a"].resolution, head["a"].nodata) == (70, 13, 10.5, 99.5, 1.0, -9999.0)


def test_strips_by_plain_loops():
    """What is written, undone byte by byte."""
    z = np.random.default_rng(4).normal(0, 9, (3, 6)).astype(np.float32)
    raw = zlib.decompress(raster.encode_block(z, "deflate"))
    for i in range(3):
        line, total, plain = raw[i * 24 : (i + 1) * 24], 0, []
        for b in line:
            total = (total + b) % 256
            plain.append(total)
        values = [struct.unpack(">f", bytes(plain[k * 6 + j] for k in range(4)))[0] for j in range(6)]
        assert values == [float(v) for v in z[i]]


def test_a_failed_job_and_overwriting(spark, tmp_path):
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, 2.0)], "tile string, row int, col int, z double")
    grids = spark.createDataFrame([("a", 1, 1, 0.0, 0.0), ("b", 1, 1, 0.0, 0.0)], "tile string, height int, width int, west double, north double")
    path = f"file://{tmp_path}/out"
    raster.write_rasters(cells, grids, path, ["z"])
    bad = cells.withColumn("z", F.when(F.col("tile") == "a", 5.0).otherwise(F.expr("raise_error('lost')").cast("double")))
    with pytest.raises(Exception, match="lost"):
        raster.write_rasters(bad, grids, path, ["z"], mode="overwrite")
    assert {(r.tile, r.v) for r in raster.read_rasters(spark, path, "z").collect()} == {("a", 1.0), ("b", 2.0)}
    raster.write_rasters(cells.where("tile = 'a'").withColumn("z", F.lit(7.0)), grids, path, ["z"], mode="overwrite")
    assert [(r.tile, r.v) for r in raster.read_rasters(spark, path, "z").collect()] == [("a", 7.0)] and os.listdir(tmp_path / "out") == ["a_z.tif"]


def test_what_is_refused(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"no tiff at all")
    with pytest.raises(ValueError, match="not a TIFF"):
        raster.read_header(f"{tmp_path}/x.tif")
    (tmp_path / "y.tif").write_bytes(made(np.zeros((2, 2), np.float32), compression=5))
    with pytest.raises(ValueError, match="compression 5"):
        raster.decode_block(b"", raster.read_header(f"{tmp_path}/y.tif"), 2)
    with pytest.raises(ValueError, match="compress is"):
        raster._Writer({"path": str(tmp_path), "compress": "lzw"}, False)
