"""Neighbourhood operators as window functions along rows and columns of dense cells.

A window partition is one row or one column of one tile, so its size is bounded by the tile,
never by the table. Windows along the same axis share one shuffle and sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def wr() -> WindowSpec:
    """Along a row of a tile."""
    return Window.partitionBy("tile", "row").orderBy("col")


def wc() -> WindowSpec:
    """Along a column of a tile."""
    return Window.partitionBy("tile", "col").orderBy("row")


def _along(z: Column, w, r: float) -> Column:
    """Central difference, one-sided at the ends of the raster, 0 on a line of one cell. NULL next to a missing cell."""
    before, after = F.lag(z).over(w), F.lead(z).over(w)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return F.when(first & last, 0.0).when(first, after - z).when(last, z - before).otherwise((after - before) / 2) / F.lit(float(r))


def gradient(cells: DataFrame, band: str, dx: str, dy: str, resolution: float = 1.0) -> DataFrame:
    z = F.col(band)
    return cells.withColumn(dx, _along(z, wr(), resolution)).withColumn(dy, _along(z, wc(), resolution))


def slope(cells: DataFrame, band: str = "z", out: str = "slope", resolution: float = 1.0) -> DataFrame:
    g = gradient(cells, band, "_gx", "_gy", resolution)
    return g.withColumn(out, F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))).drop("_gx", "_gy")


def curvature(cells: DataFrame, band: str = "z", out: str = "curvature", resolution: float = 1.0) -> DataFrame:
    """The gradient of the gradient, summed over both axes."""
    g = gradient(cells, band, "_gx", "_gy", resolution)
    return g.withColumn("_xx", _along(F.col("_gx"), wr(), resolution)).withColumn("_yy", _along(F.col("_gy"), wc(), resolution)).withColumn(out, F.col("_xx") + F.col("_yy")).drop("_gx", "_gy", "_xx", "_yy")


def openness(cells: DataFrame, band: str = "z", radii=(3, 7, 15, 31)) -> DataFrame:
    """openness_s1, ...: height above the middle of the extremes of a square, one column per radius."""
    out = cells
    for i, r in enumerate(radii, 1):
        out = out.withColumn(f"_a{i}", F.max(band).over(wr().rowsBetween(-r, r))).withColumn(f"_b{i}", F.min(band).over(wr().rowsBetween(-r, r)))
    for i, r in enumerate(radii, 1):
        w = wc().rowsBetween(-r, r)
        out = out.withColumn(f"openness_s{i}", F.col(band) - (F.max(f"_a{i}").over(w) + F.min(f"_b{i}").over(w)) / 2)
    return out.drop(*[f"_{k}{i}" for k in "ab" for i in range(1, len(radii) + 1)])


def neighbor_count(cells: DataFrame, flag: str, out: str = "neighbors") -> DataFrame:
    """How many of the 3 x 3 cells around a cell, itself included, are flagged."""
    n = cells.withColumn("_beside", F.sum(F.col(flag).cast("int")).over(wr().rowsBetween(-1, 1)))
    return n.withColumn(out, F.sum("_beside").over(wc().rowsBetween(-1, 1))).drop("_beside")


def step_distance(cells: DataFrame, flag: str, out: str) -> DataFrame:
    """Steps along rows and columns to the nearest flagged cell, NULL if the tile has none; exact, by running minima."""
    row, col = F.col("row"), F.col("col")
    up = row - F.last(F.when(F.col(flag), row), True).over(wc().rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(F.when(F.col(flag), row), True).over(wc().rowsBetween(0, Window.unboundedFollowing)) - row
    d = cells.withColumn("_d", F.least(up, down))
    left = F.min(F.col("_d") - col).over(wr().rowsBetween(Window.unboundedPreceding, 0)) + col
    right = F.min(F.col("_d") + col).over(wr().rowsBetween(0, Window.unboundedFollowing)) - col
    return d.withColumn(out, F.least(left, right)).drop("_d")


def dilate(cells: DataFrame, flag: str, steps: int, out: str) -> DataFrame:
    """Cells within that many steps of a flagged one."""
    return step_distance(cells, flag, "_s").withColumn(out, F.coalesce(F.col("_s") <= steps, F.lit(False))).drop("_s")


def boundary_band(cells: DataFrame, mask: str = "mask", inner: int = 1, outer: int = 1, out: str = "boundary_band") -> DataFrame:
    """Masked cells within inner steps of an unmasked one or of the outside, and unmasked ones within outer steps of a masked one."""
    inner, outer = max(inner, 1), max(outer, 1)
    c = cells.withColumn("_not", ~F.col(mask))
    c = step_distance(step_distance(c, "_not", "_in"), mask, "_out")
    whole_row, whole_col = wr().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), wc().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = F.least(F.col("col") + 1, F.max("col").over(whole_row) + 1 - F.col("col"), F.col("row") + 1, F.max("row").over(whole_col) + 1 - F.col("row"))
    c = c.withColumn("_edge", edge)
    return c.withColumn(out, F.when(F.col(mask), F.least("_in", "_edge") <= inner).otherwise(F.coalesce(F.col("_out") <= outer, F.lit(False)))).drop("_not", "_in", "_out", "_edge")


def median(cells: DataFrame, band: str = "z", size: int = 3, out: str = "median") -> DataFrame:
    """Median of the size x size cells around a cell; beyond the border the edge cells count again. Missing cells are left out: of n
    values the one of rank n // 2 counts, and where there is none the median is NULL."""
    half = range(-(size // 2), size - size // 2)

    def around(value: Column, w: WindowSpec) -> list[Column]:
        first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
        last = F.last(value).over(w.rowsBetween(0, Window.unboundedFollowing))
        # a struct or an array is NULL only beyond the border
        return [value if k == 0 else F.coalesce(F.lag(value, -k).over(w), first) if k < 0 else F.coalesce(F.lead(value, k).over(w), last) for k in half]

    c = cells.withColumn("_own", F.struct(F.col(band).alias("v")))
    c = c.withColumn("_line", F.array(*around(F.col("_own"), wr())))
    c = c.withColumn("_all", F.flatten(F.array(*around(F.col("_line"), wc()))))
    there = F.array_sort(F.array_compact(F.transform("_all", lambda x: x["v"])))
    return c.withColumn("_all", there).withColumn(out, F.get("_all", F.floor(F.size("_all") / 2).cast("int"))).drop("_own", "_line", "_all")


def median3(cells: DataFrame, band: str = "z", out: str = "median") -> DataFrame:
    """Median of 3 x 3 cells."""
    return median(cells, band, 3, out)


def mean3(cells: DataFrame, band: str = "z", out: str = "mean") -> DataFrame:
    """Mean of those of the 3 x 3 cells that aren't NULL."""
    w = wr().rowsBetween(-1, 1)
    c = cells.withColumn("_sum", F.sum(band).over(w)).withColumn("_n", F.count(band).over(w))
    w = wc().rowsBetween(-1, 1)
    return c.withColumn(out, F.sum("_sum").over(w) / F.nullif(F.sum("_n").over(w), F.lit(0))).drop("_sum", "_n")


def _smooth_line(cells: DataFrame, keys: list[str], at: str, band: str, weights: list[float]) -> DataFrame:
    """A weighted sum along lines of cells; beyond an end the line is mirrored, end cell included."""
    r = len(weights) // 2
    lines = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("i"), F.col(band).alias("v")))).alias("l"))
    n = F.size("l")

    def mirrored(i: Column) -> Column:
        m = F.pmod(i, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)

    w = F.array(*[F.lit(x) for x in weights])
    value = lambda x: F.aggregate(F.sequence(F.lit(0), F.lit(2 * r)), F.lit(0.0), lambda acc, k: acc + F.get(w, k) * F.get(F.col("l"), mirrored(x["i"] + k - r))["v"])
    # `i` counts from 0 on dense cells, so it is also the place in the array
    return lines.select(*keys, F.explode(F.transform("l", lambda x: F.struct(x["i"].alias(at), value(x).alias(band)))).alias("c")).select(*keys, f"c.{at}", f"c.{band}")


def gaussian(cells: DataFrame, band: str = "z", sigma: float = 1.0, out: str = "smooth") -> DataFrame:
    """Gaussian filter cut at 4 sigma, rows then columns. Needs dense cells without NULL."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    w = [x / sum(w) for x in w]
    smooth = _smooth_line(_smooth_line(cells.select("tile", "row", "col", F.col(band).alias(out)), ["tile", "row"], "col", out, w), ["tile", "col"], "row", out, w)
    return cells.join(smooth, ["tile", "row", "col"])


def laplacian(cells: DataFrame, band: str, out: str) -> DataFrame:
    """Sum of the four neighbours minus four times the cell; 0 outside."""
    around = [F.coalesce(f(band).over(w), F.lit(0.0)) for w in (wc(), wr()) for f in (F.lag, F.lead)]
    return cells.withColumn(out, around[0] + around[1] + around[2] + around[3] - 4 * F.col(band))
