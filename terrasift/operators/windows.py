"""Overlapping windows of cells: cutting, judging and blending back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import positions
from .tiles import with_tiles


def window_starts(grids: DataFrame, size: int, stride: int) -> DataFrame:
    """(tile, top, left) of the windows of each grid (tile, height, width)."""
    t = grids.select("tile", "width", F.explode(positions(F.col("height"), size, stride)).alias("top"))
    return t.select("tile", "top", F.explode(positions(F.col("width"), size, stride)).alias("left"))


def cut_windows(cells: DataFrame, grids: DataFrame, size: int, stride: int) -> DataFrame:
    """The cells of each window, with its top and left and the place i, j in it. A cell finds its windows by
    arithmetic on its own coordinates, so there is no range join."""
    inside = lambda at, c: F.filter(at, lambda p: (p <= F.col(c)) & (F.col(c) < p + size))
    c = with_tiles(cells, grids.select("tile", "height", "width"))
    c = c.withColumn("top", F.explode(inside(positions(F.col("height"), size, stride), "row"))).withColumn("left", F.explode(inside(positions(F.col("width"), size, stride), "col")))
    return c.withColumn("i", F.col("row") - F.col("top")).withColumn("j", F.col("col") - F.col("left")).drop("height", "width")


def sample_ids(windows: DataFrame) -> DataFrame:
    return windows.withColumn("sample_id", F.format_string("%s_r%05d_c%05d", "tile", "top", "left"))


def window_validity(windows: DataFrame, band: str, size: int, least: float = 0.95) -> DataFrame:
    """(tile, top, left, valid_ratio) of windows with enough valid cells; cells beyond the raster count as missing."""
    v = windows.groupBy("tile", "top", "left").agg((F.count(band) / F.lit(float(size * size))).alias("valid_ratio"))
    return v.where(F.col("valid_ratio") >= least)


def blend(windows: DataFrame, band: str, out: str = "blended") -> DataFrame:
    """Mean over the windows that cover a cell; NULL if any of them misses it."""
    return windows.groupBy("tile", "row", "col").agg(F.when(F.count(band) == F.count(F.lit(1)), F.avg(band)).alias(out), F.count(F.lit(1)).alias("covers"))


def flip(cells: DataFrame, horizontal: bool = False, vertical: bool = False) -> DataFrame:
    """Mirrored cells, by the extent of each tile."""
    size = cells.groupBy("tile").agg(F.max("row").alias("_h"), F.max("col").alias("_w"))
    c = with_tiles(cells, size)
    if horizontal:
        c = c.withColumn("col", F.col("_w") - F.col("col"))
    if vertical:
        c = c.withColumn("row", F.col("_h") - F.col("row"))
    return c.drop("_h", "_w")
