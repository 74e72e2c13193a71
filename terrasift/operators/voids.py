"""Simulated voids, and points made from void cells.

Shapes are candidates numbered 1, 2, ...; a cell belongs to the first that covers it. How many shapes a
sample needs to reach its target follows from a running count over them, so nothing is drawn in a loop (simulate_voids). Where
each shape depends on the mask so far, windows are folded one by one (voids_in_sequence).
All draws are md5 of their keys: reruns and other engines agree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import poisson, uniform
from .lines import whole_groups

STRATEGIES = ("irregular", "block", "vegetation_priority")


def choose_strategy(samples: DataFrame, seed: int = 0) -> DataFrame:
    """Adds strategy by the tile's draw."""
    return samples.withColumn("strategy", F.get(F.array(*[F.lit(s) for s in STRATEGIES]), F.floor(uniform(F.lit(seed), F.lit("strategy"), "tile") * len(STRATEGIES)).cast("int")))


def _draw(name: str, seed: int, low: float, high: float):
    return F.lit(low) + F.floor(uniform(F.lit(seed), F.lit(name), F.col("tile"), F.col("k")) * F.lit(high - low))


def _centres(cells: DataFrame, shapes: DataFrame, seed: int, weight: str | None) -> DataFrame:
    """(tile, k, at_row, at_col): centres drawn evenly, or in proportion to a weight by its running sum. shapes: (tile, shapes), how many."""
    k = F.explode(F.sequence(F.lit(1), F.col("shapes"))).alias("k")
    if weight is None:
        size = cells.groupBy("tile").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
        size = size.join(shapes, "tile").select("tile", "h", "w", k)
        pick = lambda name, n: F.floor(uniform(F.lit(seed), F.lit(name), F.col("tile"), F.col("k")) * F.col(n))
        return size.select("tile", "k", pick("row", "h").cast("int").alias("at_row"), pick("col", "w").cast("int").alias("at_col"))
    # running sums within rows of cells and over rows, so no window holds a tile
    rows = cells.groupBy("tile", "row").agg(F.sum(weight).alias("n"))
    before = Window.partitionBy("tile").orderBy("row")
    rows = rows.withColumn("hi", F.sum("n").over(before)).withColumn("lo", F.col("hi") - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("tile")))
    u = F.col("all") * uniform(F.lit(seed), F.lit("weight"), F.col("tile"), F.col("k"))
    drawn = rows.where("all > 0").groupBy("tile").agg(F.first("all").alias("all")).join(shapes, "tile").select("tile", "all", k).withColumn("u", u)
    at = drawn.join(rows.drop("all", "n"), "tile").where("lo <= u and u < hi").select("tile", "k", F.col("row"), (F.col("u") - F.col("lo")).alias("rest"))
    line = cells.withColumn("chi", F.sum(weight).over(Window.partitionBy("tile", "row").orderBy("col"))).withColumn("clo", F.col("chi") - F.col(weight))
    hit = at.join(line.select("tile", "row", "col", "clo", "chi"), ["tile", "row"]).where("clo <= rest and rest < chi")
    return hit.select("tile", "k", F.col("row").alias("at_row"), F.col("col").alias("at_col"))


def simulate_voids(cells: DataFrame, strategy: str = "irregular", coverage=(0.05, 0.22), shapes: int | None = None, radius=(6, 24), valid: str | None = None, weight: str | None = None, seed: int = 0, out: str = "void") -> DataFrame:
    """Adds a boolean: the cells of the first shapes that together cover the sample's target number of valid cells.

    irregular: disks; block: rectangles with sides in the radius range; vegetation_priority: disks at centres
    drawn by weight. Centres lie on valid cells where a valid band is given, else anywhere, as where the tile's weight is 0. Cells that
    aren't valid are never void, and the target is at least one cell and at most 90 % of the valid ones. There are `shapes`
    candidates; without a number, eight times as many as it takes to cover the target without overlap, and at least 200.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    ok = F.col(valid) if valid else F.lit(True)
    low, high = coverage[0], min(coverage[1], 0.9)
    target = cells.groupBy("tile").agg(F.count_if(ok).alias("n")).withColumn("target", F.greatest(F.floor(F.col("n") * (F.lit(low) + F.lit(high - low) * uniform(F.lit(seed), F.lit("target"), F.col("tile")))), F.lit(1)))
    mean = sum(r * r if strategy == "block" else math.pi * r * r for r in range(*radius)) / max(len(range(*radius)), 1)
    many = F.lit(shapes) if shapes else F.greatest(F.ceil(8 * F.col("target") / F.lit(max(mean, 1.0))), F.lit(200)).cast("int")
    count = target.select("tile", many.alias("shapes"))
    on = cells.withColumn("_on", ok.cast("double")) if valid else cells
    even = _centres(on, count, seed, "_on" if valid else None)
    if strategy == "vegetation_priority" and weight:
        heavy = _centres(cells, count, seed, weight)
        even = heavy.unionByName(even.join(heavy.select("tile").distinct(), "tile", "left_anti"))
    if strategy == "block":
        s = even.withColumn("high", _draw("high", seed, *radius)).withColumn("wide", _draw("wide", seed, *radius))
        covers = (F.col("row") >= F.col("at_row")) & (F.col("row") < F.col("at_row") + F.col("high")) & (F.col("col") >= F.col("at_col")) & (F.col("col") < F.col("at_col") + F.col("wide"))
        lines = s.withColumn("row", F.explode(F.sequence(F.col("at_row"), (F.col("at_row") + F.col("high") - 1).cast("int"))))
    else:
        s = even.withColumn("r", _draw("radius", seed, *radius).cast("int"))
        d = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
        covers = d("row", "at_row") + d("col", "at_col") <= F.col("r") * F.col("r")
        lines = s.withColumn("row", F.explode(F.sequence(F.col("at_row") - F.col("r"), F.col("at_row") + F.col("r"))))
    # a shape meets the rows it reaches, not all cells of the tile
    first = cells.where(ok).select("tile", "row", "col").join(lines, ["tile", "row"]).where(covers).groupBy("tile", "row", "col").agg(F.min("k").alias("k"))
    news = first.groupBy("tile", "k").agg(F.count("*").alias("new"))
    before = Window.partitionBy("tile").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    used = news.withColumn("got", F.coalesce(F.sum("new").over(before), F.lit(0))).join(target, "tile").where("got < target").select("tile", "k")
    void = first.join(used, ["tile", "k"]).select("tile", "row", "col", F.lit(True).alias(out))
    return cells.join(void, ["tile", "row", "col"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def void_points(cells: DataFrame, band: str, void: str = "void", mean: float = 4.0, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """(tile, row, col, i, x, y, z): a Poisson number of points in each void cell, jittered within it; y grows to the north from 0 at row 0."""
    c = cells.where(F.col(void)).withColumn("n", poisson(uniform(F.lit(seed), F.lit("n"), "tile", "row", "col"), mean)).where("n > 0")
    c = c.withColumn("i", F.explode(F.expr("sequence(1, n)")))
    jitter = lambda name: uniform(F.lit(seed), F.lit(name), F.col("tile"), F.col("row"), F.col("col"), F.col("i"))
    return c.select("tile", "row", "col", "i", ((F.col("col") + jitter("x")) * resolution).alias("x"), (-(F.col("row") + jitter("y")) * resolution).alias("y"), F.col(band).alias("z"))


#: Of a window in sequence: shapes at the most, radii of disks, the share of shapes after which the mask is widened and by how many steps.
DISKS, RECTANGLES = 200, 64
RADII, WEIGHTED_RADII = (6, 24), (8, 28)
WIDENED, STEPS, WEIGHTED_STEPS = 0.75, (1, 4), (1, 3)


def draw(seed: int, name: str, *keys) -> float:
    """The number in [0, 1) of columns.uniform for the same keys."""
    text = "|".join(str(k) for k in (seed, name, *keys))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / (1 << 32)


def widen(mask: np.ndarray, steps: int) -> np.ndarray:
    """The mask with all cells within so many steps along rows and columns."""
    for _ in range(steps):
        wide = mask.copy()
        wide[1:] |= mask[:-1]
        wide[:-1] |= mask[1:]
        wide[:, 1:] |= mask[:, :-1]
        wide[:, :-1] |= mask[:, 1:]
        mask = wide
    return mask


def voids_of_window(valid: np.ndarray, weight: np.ndarray | None, strategy: str, coverage: tuple[float, float], seed: int, name: str) -> tuple[np.ndarray, bool]:
    """The mask of one window, shape after shape until the target is reached, and whether it was.

    irregular: disks around valid cells, after most of which the whole mask so far is widened; block: rectangles; vegetation_priority:
    widened disks around cells drawn by weight, or irregular where there is no weight. The mask is cut to valid cells after each.
    """
    u = lambda what, k, low=0, high=1: low + int(draw(seed, what, name, k) * (high - low))
    height, width = valid.shape
    mask, places = np.zeros(valid.shape, bool), np.flatnonzero(valid)
    if not len(places):
        return mask, True
    low, high = max(coverage[0], 0.0), min(coverage[1], 0.9)
    target = max(1, int(len(places) * (low + (high - low) * draw(seed, "target", name))))
    rows, cols = np.ogrid[:height, :width]
    heavy = np.cumsum(np.where(valid, weight, 0.0).ravel()) if strategy == "vegetation_priority" and weight is not None else np.zeros(1)
    if strategy == "vegetation_priority" and heavy[-1] <= 0:
        strategy = "irregular"
    for k in range(RECTANGLES if strategy == "block" else DISKS):
        if strategy == "block":
            tall, wide = (u(what, k, max(8, n // 12), max(12, n // 4)) for what, n in (("high", height), ("wide", width)))
            top, left = u("row", k, 0, max(1, height - tall)), u("col", k, 0, max(1, width - wide))
            mask[top : top + tall, left : left + wide] = True
        elif strategy == "irregular":
            row, col = divmod(int(places[u("place", k, 0, len(places))]), width)
            mask |= (rows - row) ** 2 + (cols - col) ** 2 <= u("radius", k, *RADII) ** 2
            if draw(seed, "widened", name, k) < WIDENED:
                mask = widen(mask, u("steps", k, *STEPS))
        else:
            row, col = divmod(int(np.searchsorted(heavy, draw(seed, "weight", name, k) * heavy[-1], "right")), width)
            disk = (rows - row) ** 2 + (cols - col) ** 2 <= u("radius", k, *WEIGHTED_RADII) ** 2
            mask |= widen(disk, u("steps", k, *WEIGHTED_STEPS))
        mask &= valid
        if mask.sum() >= target:
            return mask, True
    return mask, False


def voids_in_sequence(windows: DataFrame, strategy: str | None = None, coverage=(0.05, 0.22), valid: str | None = None, weight: str | None = None, seed: int = 0, out: str = "void") -> DataFrame:
    """Adds a boolean, and reached: whether the window's target was met before its shapes ran out (200 disks, 64 rectangles).

    windows: cells of windows that are tiles of their own, and so of a bounded size; each is one task's, which folds its shapes over a mask. Without a
    strategy each window has that of its row in column strategy. All draws are md5 of the window's name: reruns and other engines agree.
    """
    if strategy is not None and strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    schema = T.StructType([*(f for f in windows.schema.fields if f.name not in (out, "reached")), T.StructField(out, T.BooleanType()), T.StructField("reached", T.BooleanType())])
    dealt = windows.drop(out, "reached").repartition("tile").sortWithinPartitions("tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["tile"]):
            void, reached = np.zeros((2, table.num_rows), bool)
            for lo, hi in zip(starts, np.r_[starts[1:], table.num_rows], strict=True):
                part = table.slice(lo, hi - lo)
                row, col = (part[c].to_numpy().astype(np.int64) for c in ("row", "col"))
                shape = (int(row.max()) + 1, int(col.max()) + 1)
                ok, heavy = np.zeros(shape, bool), np.zeros(shape)
                ok[row, col] = pc.fill_null(part[valid], False).to_numpy() if valid else True
                if weight:
                    heavy[row, col] = np.nan_to_num(part[weight].to_numpy().astype(float), nan=0.0, posinf=0.0, neginf=0.0)
                how = strategy or part["strategy"][0].as_py()
                mask, met = voids_of_window(ok, heavy if weight else None, how, coverage, seed, str(part["tile"][0].as_py()))
                void[lo:hi], reached[lo:hi] = mask[row, col], met
            full = pa.Table.from_arrays([*table.columns, pa.array(void), pa.array(reached)], [*table.column_names, out, "reached"])
            yield from full.select(schema.names).to_batches(max_chunksize=1 << 14)

    return dealt.mapInArrow(run, schema)
