"""Filling and repair of elevation rasters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, ramp
from .components import component_sizes, label_components
from .nearest import nearest_fill, nearest_valid, search_fill
from .stencil import dilate, gaussian, median, neighbor_count
from .tiles import with_tiles

KEY = ["tile", "row", "col"]


def fill_small_holes(cells: DataFrame, band: str, max_area: int = 32, out: str = "filled") -> DataFrame:
    """Fills missing areas of at most max_area cells from the nearest valid cell; larger ones stay."""
    if max_area <= 0:
        return cells.withColumn(out, F.col(band))
    c = label_components(cells.withColumn("_hole", F.col(band).isNull()), "_hole", "_label")
    c = nearest_valid(component_sizes(c, "_label", "_area"), band, "_near", "_d")
    return c.withColumn(out, F.coalesce(F.col(band), F.when(F.col("_area") <= max_area, F.col("_near")))).drop("_hole", "_label", "_area", "_near", "_d")


def interpolate(cells: DataFrame, band: str, method: str = "idw", sigma: float = 0.0, radius: float = 64, out: str = "filled", smoothing: int = 0) -> DataFrame:
    """Fills all missing cells and keeps the valid ones: nearest or idw (search_fill, 0 beyond the radius), and either with a Gaussian filter of what was filled."""
    kinds = {"nearest": lambda c: nearest_fill(c, band, out), "idw": lambda c: search_fill(c, band, radius, smoothing, out)}
    base, _, smooth = method.partition("_")
    if base not in kinds or smooth not in ("", "gaussian"):
        raise ValueError(f"unknown method {method!r}")
    done = kinds[base](cells)
    if smooth and sigma > 0:
        done = gaussian(done, out, sigma, "_smooth").withColumn(out, F.coalesce(F.col(band), F.col("_smooth"))).drop("_smooth")
    return done


def promote_small_gaps(cells: DataFrame, observed: str = "observed", support: str = "support", least: int = 4, max_area: int = 4, out: str = "promoted") -> DataFrame:
    """Support, and those unsupported cells with enough observed and supported neighbours whose area is small."""
    c = neighbor_count(neighbor_count(cells, observed, "_o"), support, "_s")
    c = c.withColumn("_gap", ~F.col(support) & (F.col("_o") >= least) & (F.col("_s") >= least))
    c = component_sizes(label_components(c, "_gap", "_label"), "_label", "_area")
    return c.withColumn(out, F.col(support) | F.coalesce(F.col("_area") <= max_area, F.lit(False))).drop("_o", "_s", "_gap", "_label", "_area")


def tiny_holes(cells: DataFrame, band: str, domain: str, max_area: int = 8, least: int = 5, out: str = "tiny_hole") -> DataFrame:
    """Cells of the domain in missing areas of at most max_area cells, one of which has at least that many valid neighbours. Areas
    are those of all missing cells, wherever the domain ends, so the rim of a large void is none."""
    c = neighbor_count(cells.withColumn("_ok", F.col(band).isNotNull()), "_ok", "_n").withColumn("_hole", ~F.col("_ok"))
    c = label_components(c, "_hole", "_label")
    per = c.where("_label is not null").groupBy("tile", "_label").agg(F.count("*").alias("_area"), F.max("_n").alias("_most"))
    tiny = F.coalesce((F.col("_area") <= max_area) & (F.col("_most") >= least), F.lit(False)) & F.col(domain)
    return c.join(per, ["tile", "_label"], "left").withColumn(out, tiny).drop("_ok", "_n", "_hole", "_label", "_area", "_most")


@dataclass(frozen=True)
class Repair:
    """How an elevation is repaired: how far and how cells are filled, what gaps count as supported, how lone spikes are
    drawn to their median, which holes are filled last, and between which densities and penetrations trust grows."""

    method: str = "idw"
    sigma: float = 0.0
    max_distance: float = 48.0
    smoothing: int = 1
    support_dilation: int = 0
    gap_area: int = 4
    gap_neighbors: int = 4
    median_size: int = 3
    median_share: float = 0.75
    hole_area: int = 8
    hole_neighbors: int = 5
    hole_distance: float = 12.0
    hole_smoothing: int = 1
    density: tuple[float, float] = (2.0, 5.0)
    penetration: tuple[float, float] = (0.03, 0.2)
    low_at: float = 0.55


def reference_dem(cells: DataFrame, dem: str = "dem", ground_density: str = "ground_density", ratio: str | None = "ground_penetration_ratio", support: Column | None = None, observed: Column | None = None, how: Repair = Repair()) -> DataFrame:
    """The repaired elevation of supported cells with how far to trust it.

    Adds reference, valid, support, low_confidence, tiny_hole, repair_weight, confidence, and filled. valid: cells observed (by
    default all) that have an elevation. support: given cells (by default the valid ones), dilated, with the valid ones and
    small gaps. Confidence is 0.7 of a ramp over the ground density and 0.3 of one over the penetration (1 without such a
    band), 0 off support. Supported cells without a valid one are filled from the valid ones that can be trusted, over
    max_distance (0: any); those of low confidence are blended with that surface by their confidence. What was filled or blended
    is drawn to its local median; holes of a few cells in or beside support are filled last.
    """
    z, steps = F.col(dem), how
    c = cells.withColumn("valid", F.coalesce(observed if observed is not None else F.lit(True), F.lit(False)) & z.isNotNull())
    c = c.withColumn("_given", F.coalesce(support, F.lit(False)) if support is not None else F.col("valid"))
    if steps.support_dilation > 0:
        c = dilate(c, "_given", steps.support_dilation, "_wide").withColumn("_given", F.col("_wide")).drop("_wide")
    c = c.withColumn("_given", F.col("_given") | F.col("valid"))
    c = (promote_small_gaps(c, "valid", "_given", steps.gap_neighbors, steps.gap_area, "support") if steps.gap_area > 0 else c.withColumn("support", F.col("_given"))).drop("_given")
    trust = ramp(F.coalesce(F.col(ratio), F.lit(0.0)), *steps.penetration) if ratio else F.lit(1.0)
    trust = 0.7 * ramp(F.coalesce(F.col(ground_density), F.lit(0.0)), *steps.density) + 0.3 * trust
    c = c.withColumn("confidence", F.when(F.col("support"), trust).otherwise(0.0))
    c = c.withColumn("low_confidence", F.col("valid") & (F.col("confidence") < steps.low_at))
    c = nearest_valid(c.withColumn("_seen", F.when(F.col("valid"), z)), "_seen", "_n", "_distance")
    near = F.coalesce(F.col("_distance") <= steps.max_distance, F.lit(False)) if steps.max_distance > 0 else F.lit(True)
    c = c.withColumn("filled", F.col("support") & ~F.col("valid") & near).drop("_n", "_distance")
    # an elevation that isn't observed is a source where it isn't to be filled itself
    c = c.withColumn("_source", F.when(~F.col("low_confidence") & ~F.col("filled"), z))
    c = interpolate(c, "_source", steps.method, steps.sigma, steps.max_distance, "_surface", steps.smoothing)
    k = F.col("confidence")
    c = c.withColumn("_z", F.when(F.col("low_confidence"), k * z + (1 - k) * F.col("_surface")).when(F.col("filled"), F.col("_surface")).otherwise(F.col("_seen")))
    c = c.withColumn("repair_weight", F.when(F.col("filled"), 1.0).when(F.col("low_confidence"), 1 - k).otherwise(0.0)).drop("_seen", "_source", "_surface")
    if steps.median_size > 1:
        c = median(nearest_fill(c, "_z", "_full"), "_full", steps.median_size, "_median")
        w = clip(F.col("repair_weight") * steps.median_share, 0.0, 1.0)
        c = c.withColumn("_z", F.when(F.col("_z").isNotNull(), (1 - w) * F.col("_z") + w * F.col("_median"))).drop("_full", "_median")
    if steps.hole_area <= 0:
        return c.withColumn("tiny_hole", F.lit(False)).withColumn("reference", F.col("_z")).drop("_z")
    c = tiny_holes(dilate(c, "support", 1, "_domain"), "_z", "_domain", steps.hole_area, steps.hole_neighbors)
    c = search_fill(c, "_z", steps.hole_distance, steps.hole_smoothing, "_idw")
    return c.withColumn("reference", F.coalesce(F.col("_z"), F.when(F.col("tiny_hole"), F.col("_idw")))).drop("_z", "_domain", "_idw")


def confidence_map(cells: DataFrame, mask: str = "mask", partial: str = "partial", dsm: str = "dsm", coarse: str = "coarse", ratio: str = "ratio", scale: float = 24.0, out: str = "confidence") -> DataFrame:
    """1 outside holes; in them 0.5 by distance to a valid cell, 0.35 by penetration, 0.15 by how near DSM and coarse surface are."""
    c = cells.withColumn("_valid", F.when(~F.col(mask), F.col(partial)))
    c = nearest_valid(c, "_valid", "_n", "_d").withColumn("_h", F.abs(F.col(dsm) - F.col(coarse)))
    span = c.groupBy("tile").agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    c = with_tiles(c, span)
    height = F.coalesce((F.col("_h") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))
    near = F.coalesce(F.exp(-F.col("_d") / F.lit(max(scale, 1e-6))), F.lit(0.0))
    score = 0.5 * near + 0.35 * clip(F.coalesce(F.col(ratio), F.lit(1.0)), 0.0, 1.0) + 0.15 * (1 - height)
    return c.withColumn(out, F.when(F.col(mask), clip(score, 0.0, 1.0)).otherwise(1.0)).drop("_valid", "_n", "_d", "_h", "_lo", "_hi")


def display_stretch(cells: DataFrame, band: str = "z", out: str = "grey") -> DataFrame:
    """0 to 255 between the 2nd and the 98th percentile of the tile."""
    span = cells.groupBy("tile").agg(F.percentile(band, 0.02).alias("_lo"), F.percentile(band, 0.98).alias("_hi"))
    share = clip((F.col(band) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), 0.0, 1.0)
    return with_tiles(cells, span).withColumn(out, F.floor(F.coalesce(share, F.lit(0.0)) * 255).cast("int")).drop("_lo", "_hi")
