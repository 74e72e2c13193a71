"""Nearest valid cells, the exact distance to them, and fills from them.

First pass: the nearest valid cell of the same column above and below, by two window functions. Second pass: along
rows, the lower envelope of the parabolas that the columns' distances make. Both take time in proportion to the
cells, however wide a hole is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lines import along_rows, envelope
from .stencil import mean3, wc

#: Lacking cells weighed at once against a block.
STEP = 64


def _sources(cells: DataFrame, band: str) -> DataFrame:
    """Adds the rows and values of the nearest valid cell of the column at or above a cell (_ur, _uv) and at or below it (_dr, _dv)."""
    source = F.when(F.col(band).isNotNull(), F.struct(F.col("row").cast("double").alias("r"), F.col(band).cast("double").alias("v")))
    up = F.last(source, True).over(wc().rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(source, True).over(wc().rowsBetween(0, Window.unboundedFollowing))
    c = cells.withColumn("_u", up).withColumn("_d", down).withColumn("_row", F.col("row").cast("double"))
    return c.select("*", F.col("_u.r").alias("_ur"), F.col("_u.v").alias("_uv"), F.col("_d.r").alias("_dr"), F.col("_d.v").alias("_dv")).drop("_u", "_d")


def _pick(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where(c >= 0, np.take_along_axis(m, np.maximum(c, 0), axis=1), np.nan)


def nearest_valid(cells: DataFrame, band: str, out: str = "near", distance: str = "distance") -> DataFrame:
    """Adds the value of the nearest cell whose band isn't NULL (ties: least row, then col) and the distance; NULL if the tile has none."""

    def work(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        row, up, down = m["_row"], m["_ur"], m["_dr"]
        above = ~np.isnan(up) & (np.isnan(down) | (row - up <= down - row))
        r = np.where(above, up, down)
        there = ~np.isnan(r)
        tall = np.where(there, np.abs(r - row), 0).astype(np.int64)
        # of equal distances the least row, then the least column
        rank = np.where(there, (r - np.fmin.reduce(r, axis=1, keepdims=True)) * r.shape[1], 0).astype(np.int64) + np.arange(r.shape[1])
        c = envelope(np.where(there, tall * tall, -1), rank)
        far = _pick(tall.astype(float), c) ** 2 + (c - np.arange(c.shape[1])) ** 2
        return {out: _pick(np.where(above, m["_uv"], m["_dv"]), c), distance: np.where(c >= 0, np.sqrt(far), np.nan)}

    return along_rows(_sources(cells, band), work, ["_row", "_ur", "_uv", "_dr", "_dv"], [out, distance]).drop("_row", "_ur", "_uv", "_dr", "_dv")


def nearest_fill(cells: DataFrame, band: str, out: str = "filled") -> DataFrame:
    """The band with every missing cell filled from the nearest valid one; 0 in tiles without any."""
    return nearest_valid(cells, band, "_near", "_d").withColumn(out, F.coalesce(F.col(band), F.col("_near"), F.lit(0.0))).drop("_near", "_d")


@F.pandas_udf(T.StructType([T.StructField(k, T.ArrayType(T.DoubleType())) for k in ("w", "s")]))
def _weigh(lr: pd.Series, lc: pd.Series, hr: pd.Series, hc: pd.Series, hv: pd.Series, radius: pd.Series) -> pd.DataFrame:
    """For each lacking cell of a block the sum of 1 / squared distance over the valid cells of another within the radius, and that of the values so weighted."""
    w, s = [], []
    for a, b, r, c, v, most in zip(lr, lc, hr, hc, hv, radius, strict=True):
        ws, ss = np.zeros(len(a)), np.zeros(len(a))
        for i in range(0, len(a), STEP):
            d2 = (a[i : i + STEP, None] - r[None]) ** 2 + (b[i : i + STEP, None] - c[None]) ** 2
            k = np.where(d2 <= most * most, 1.0 / d2, 0.0)
            ws[i : i + STEP], ss[i : i + STEP] = k.sum(1), (k * v[None]).sum(1)
        w.append(ws)
        s.append(ss)
    return pd.DataFrame({"w": w, "s": s})


def inverse_distance(cells: DataFrame, band: str, radius: float = 64, smoothing: int = 0, out: str = "idw") -> DataFrame:
    """Missing cells from all valid ones within the radius, weighted by 1 / squared distance; 0 where there is none.

    Then so many smoothing passes: what was filled becomes the mean of the 3 x 3 cells that have a value. The
    cells of a tile go in square blocks no smaller than the radius; a block that misses some meets its own valid
    cells and those of the eight blocks around it, and the partial sums of a cell meet in an aggregation.
    """
    side = max(radius, 8)
    block = [F.floor(F.col(k) / side).alias(f"_{k}") for k in ("row", "col")]
    some = lambda c, **lists: cells.where(c).groupBy("tile", *block).agg(*[F.collect_list(k).alias(n) for n, k in lists.items()])
    have = some(F.col(band).isNotNull(), hr="row", hc="col", hv=band)
    lack = some(F.col(band).isNull(), lr="row", lc="col")
    for k in ("_row", "_col"):
        lack = lack.withColumn(k, F.explode(F.array(F.col(k) - 1, F.col(k), F.col(k) + 1)))
    met = lack.join(have, ["tile", "_row", "_col"]).select("tile", "lr", "lc", _weigh("lr", "lc", "hr", "hc", "hv", F.lit(radius)).alias("p"))
    per = met.select("tile", F.explode(F.arrays_zip("lr", "lc", F.col("p.w").alias("w"), F.col("p.s").alias("s"))).alias("x"))
    per = per.groupBy("tile", F.col("x.lr").alias("row"), F.col("x.lc").alias("col")).agg(F.sum("x.s").alias("_s"), F.sum("x.w").alias("_w"))
    c = cells.join(per, ["tile", "row", "col"], "left").withColumn(out, F.coalesce(F.col(band), F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")))).drop("_s", "_w")
    return _smoothed(c, band, smoothing, out)


def search_fill(cells: DataFrame, band: str, distance: float = 64, smoothing: int = 0, out: str = "idw") -> DataFrame:
    """Missing cells from the nearest valid cell in each of the four quarters around them, weighted by 1 / distance; 0 where there is none.

    A quarter holds what is above or below a cell, its own row included, and left or right of it, its own column
    included, so a cell of the same row or column counts in two. Of equally near ones the nearest by columns is
    taken. Cells farther than the distance don't count. Then so many smoothing passes: what was filled becomes the mean of the 3 x 3
    cells that have a value. The nearest of a quarter is found by an envelope of those parabolas that have begun, so the
    work follows the number of cells and not the distance.
    """

    def work(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        row = m["_row"]
        place = np.arange(row.shape[1])
        weights = sums = np.zeros(row.shape)
        for r, v in ((m["_ur"], m["_uv"]), (m["_dr"], m["_dv"])):
            tall = np.where(np.isnan(r), distance + 1, np.abs(r - row))
            height = np.where(tall <= distance, tall * tall, -1).astype(np.int64)
            left = envelope(height, one_sided=True)
            right = envelope(height[:, ::-1], one_sided=True)[:, ::-1]
            for c in (left, np.where(right >= 0, row.shape[1] - 1 - right, -1)):
                d = np.sqrt(_pick(tall, c) ** 2 + (c - place) ** 2)
                w = np.where((d <= distance) & (d > 0), 1.0, 0.0) / np.where(d > 0, d, 1.0)
                w = np.where(np.isnan(w), 0.0, w)
                weights, sums = weights + w, sums + w * np.where(w > 0, _pick(v, c), 0.0)
        return {"_w": weights, "_s": sums}

    c = along_rows(_sources(cells, band), work, ["_row", "_ur", "_uv", "_dr", "_dv"], ["_w", "_s"])
    c = c.withColumn(out, F.coalesce(F.col(band), F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")))).drop("_row", "_ur", "_uv", "_dr", "_dv", "_w", "_s")
    return _smoothed(c, band, smoothing, out)


def _smoothed(c: DataFrame, band: str, passes: int, out: str) -> DataFrame:
    """What was filled as the mean of the 3 x 3 cells that have a value, so many times; then 0 for what has none."""
    for _ in range(passes):
        c = mean3(c, out, "_mean").withColumn(out, F.when(F.col(band).isNull() & F.col(out).isNotNull(), F.col("_mean")).otherwise(F.col(out))).drop("_mean")
    return c.withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))
