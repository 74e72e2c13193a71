"""Errors and losses of predicted rasters, per tile, and their roll-up. pred, gt: bands; mask: a weight of 0 or 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stencil import wc, wr, laplacian


def weighted(value: Column, weight: Column) -> Column:
    """Weighted mean whose divisor is at least 1."""
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1.0))


def masked_errors(cells: DataFrame, pred: str = "pred", gt: str = "gt", mask: str = "mask", by: list[str] | None = None) -> DataFrame:
    e, w = F.col(pred) - F.col(gt), F.col(mask).cast("double")
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return cells.groupBy(*(["tile"] if by is None else by)).agg((F.sum(F.abs(e)) / n).alias("mae"), F.sqrt(F.sum(e * e) / n).alias("rmse"), weighted(F.abs(e), w).alias("mask_mae"), F.sqrt(weighted(e * e, w)).alias("mask_rmse"))


def _corner(cells: DataFrame, pred: str, gt: str, mask: str) -> DataFrame:
    """Forward differences of both bands at cells that have a neighbour on either side, with the mask one step down and right."""
    c = cells
    for b in (pred, gt):
        c = c.withColumn(f"_x{b}", F.lead(b).over(wr()) - F.col(b)).withColumn(f"_y{b}", F.lead(b).over(wc()) - F.col(b))
    c = c.withColumn("_mr", F.lead(F.col(mask).cast("double")).over(wr()))
    return c.withColumn("_m", F.lead("_mr").over(wc()))


def slope_rmse(cells: DataFrame, pred: str = "pred", gt: str = "gt", mask: str = "mask") -> DataFrame:
    c = _corner(cells, pred, gt, mask).where("_m is not null")
    s = lambda b: F.sqrt(F.col(f"_x{b}") * F.col(f"_x{b}") + F.col(f"_y{b}") * F.col(f"_y{b}"))
    d = s(pred) - s(gt)
    return c.groupBy("tile").agg(F.sqrt(weighted(d * d, F.col("_m"))).alias("slope_rmse"))


def masked_l1(cells: DataFrame, pred: str = "pred", gt: str = "gt", mask: str = "mask") -> DataFrame:
    """hole_l1 within the mask, valid_l1 outside, and the plain mean l1."""
    e, w = F.abs(F.col(pred) - F.col(gt)), F.col(mask).cast("double")
    return cells.groupBy("tile").agg(weighted(e, w).alias("hole_l1"), weighted(e, 1 - w).alias("valid_l1"), F.avg(e).alias("l1"))


def grad_loss(cells: DataFrame, pred: str = "pred", gt: str = "gt", mask: str = "mask") -> DataFrame:
    """L1 of forward differences, weighted by the larger mask of the two cells, summed over both directions."""
    m = F.col(mask).cast("double")
    c = cells
    for axis, w in (("x", wr()), ("y", wc())):
        c = c.withColumn(f"_d{axis}", F.abs((F.lead(pred).over(w) - F.col(pred)) - (F.lead(gt).over(w) - F.col(gt)))).withColumn(f"_w{axis}", F.when(F.lead(m).over(w).isNotNull(), F.greatest(m, F.lead(m).over(w))))
    part = lambda a: F.coalesce(F.sum(F.col(f"_d{a}") * F.col(f"_w{a}")), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(f"_w{a}"), F.lit(0.0)), F.lit(1.0))
    return c.groupBy("tile").agg((part("x") + part("y")).alias("grad_loss"))


def curvature_loss(cells: DataFrame, pred: str = "pred", gt: str = "gt", mask: str = "mask") -> DataFrame:
    c = laplacian(laplacian(cells, pred, "_lp"), gt, "_lg")
    return c.groupBy("tile").agg(weighted(F.abs(F.col("_lp") - F.col("_lg")), F.col(mask).cast("double")).alias("curvature_loss"))


def total_loss(cells: DataFrame, first: str = "first", pred: str = "pred", gt: str = "gt", mask: str = "mask", weights=(1.0, 0.1, 0.2, 0.0)) -> DataFrame:
    """hole * (final + half the first stage) + valid + gradient + curvature, by weight."""
    final = masked_l1(cells, pred, gt, mask).select("tile", F.col("hole_l1").alias("final_l1"), "valid_l1")
    start = masked_l1(cells, first, gt, mask).select("tile", F.col("hole_l1").alias("first_l1"))
    c = final.join(start, "tile").join(grad_loss(cells, pred, gt, mask), "tile").join(curvature_loss(cells, pred, gt, mask), "tile")
    h, v, g, k = (F.lit(float(w)) for w in weights)
    return c.withColumn("loss", h * (F.col("final_l1") + 0.5 * F.col("first_l1")) + v * F.col("valid_l1") + g * F.col("grad_loss") + k * F.col("curvature_loss"))


def adversarial_losses(scores: DataFrame, real: str = "real", fake: str = "fake") -> DataFrame:
    """Least-squares losses of a generator and a discriminator from their scores."""
    r, f = F.col(real), F.col(fake)
    return scores.agg(F.avg((f - 1) * (f - 1)).alias("generator_loss"), (0.5 * (F.avg((r - 1) * (r - 1)) + F.avg(f * f))).alias("discriminator_loss"))


def eval_rollup(per_cell: DataFrame, batch: Column, pred: str = "pred", gt: str = "gt", mask: str = "mask") -> DataFrame:
    """Errors of each batch of tiles, averaged by the batch's number of tiles, beside the errors over all cells."""
    c = per_cell.withColumn("batch", batch)
    sizes = c.select("batch", "tile").distinct().groupBy("batch").agg(F.count("*").alias("_n"))
    per = masked_errors(c, pred, gt, mask, by=["batch"]).join(sizes, "batch")
    names = ["mae", "rmse", "mask_mae", "mask_rmse"]
    rolled = per.agg(*[(F.sum(F.col(n) * F.col("_n")) / F.sum("_n")).alias(n) for n in names]).withColumn("scope", F.lit("batches"))
    return rolled.unionByName(masked_errors(c, pred, gt, mask, by=[]).withColumn("scope", F.lit("global")))


def dem_metrics(cells: DataFrame, pred: str = "pred", gt: str = "gt", mask: str = "mask") -> DataFrame:
    """(tile, mae, rmse, mask_mae, mask_rmse, slope_rmse)."""
    return masked_errors(cells, pred, gt, mask).join(slope_rmse(cells, pred, gt, mask), "tile")


def mask_coverage(cells: DataFrame, mask: str = "mask") -> DataFrame:
    """(tile, coverage): the share of masked cells."""
    return cells.groupBy("tile").agg(F.avg(F.col(mask).cast("double")).alias("coverage"))


def best_epoch(history: DataFrame, metric: str) -> DataFrame:
    """History with the best value so far, and whether the epoch improved on it. One row per epoch."""
    from pyspark.sql import Window

    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("best_before", F.min(metric).over(before)).withColumn("improved", F.col("best_before").isNull() | (F.col(metric) < F.col("best_before")))
