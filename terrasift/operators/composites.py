"""Whole jobs as one plan each: points to rasters, rasters to samples, and tiles repaired window by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalize_dem, normalize_density, normalize_feature, normalize_ratio
from . import voids
from .components import settled
from .fill import Repair, confidence_map, interpolate, reference_dem
from .grid import GROUND, cell_bands, grid_specs, tile_headers
from .nearest import nearest_fill
from .samples import padded_windows, tin_surface, with_meta
from .stencil import boundary_band, curvature, openness, slope
from .tiles import with_tiles
from .windows import blend, cut_windows, sample_ids

KEY = ["tile", "row", "col"]
DENSITIES = ["all_density", "ground_density", "vegetation_density", "building_density"]
AUXILIARY = [*DENSITIES, "mean_intensity", "mean_return_num", "last_return_ratio", "ground_penetration_ratio"]
FEATURES = ["slope", "curvature", "openness_s1", "openness_s2", "openness_s3", "openness_s4"]
#: The channels of a model in their order, and by what some are divided (densities after log(1 + x)).
CHANNELS = ["partial_dem", "coarse_dem", "dsm", "mask", *AUXILIARY, "confidence_map", *FEATURES]
SCALES = {"all_density": 4.5, "ground_density": 3.5, "vegetation_density": 3.5, "building_density": 3.5, "mean_intensity": 40000.0, "mean_return_num": 4.0}
#: How a channel is normalised, by its name; others are taken as they are, with 0 for what is missing.
KINDS = {
    **dict.fromkeys(["gt_dem", "partial_dem", "coarse_dem", "dsm"], "dem"), **dict.fromkeys(DENSITIES, "density"),
    **dict.fromkeys(["mask", "last_return_ratio", "ground_penetration_ratio", "confidence_map", "boundary_band"], "ratio"),
    **dict.fromkeys([*FEATURES, "mean_intensity", "mean_return_num"], "feature"),
}
BANDS = ["dem_raw", "dem", "dem_reference", "dsm", *AUXILIARY, "dem_valid_mask", "dem_support_mask", "dem_lowconf_mask", "dem_tinyhole_mask", "dem_repair_weight", "dem_confidence"]


def raster_build(points: DataFrame, method: str = "tin", resolution: float = 1.0, how: Repair = Repair(), max_edge: float = 20.0, hole_area: int = 32) -> DataFrame:
    """(tile, row, col and all BANDS) of the points of each tile, over all its cells.

    mean: the elevation is the mean of a cell's ground points, repaired by reference_dem; tin: triangles, and what they leave open by
    inverse distance. The surface is the highest point of a cell, else that of the nearest cell that has one.
    """
    if method not in ("tin", "mean"):
        raise ValueError("method is tin or mean")
    grids = settled(grid_specs(tile_headers(points), resolution))
    cells = settled(nearest_fill(cell_bands(points, grids, resolution), "dsm", "_dsm").withColumn("dsm", F.col("_dsm")).drop("_dsm"))
    if method == "mean":
        done = reference_dem(cells, support=F.col("all_density") > 0, how=how).withColumn("dem_raw", F.col("dem"))
    else:
        done = tin_surface(points.where(F.col("cls") == GROUND), grids, cells, max_edge, hole_area, how.max_distance, how.smoothing)
        done = done.withColumn("dem_raw", F.col("reference")).withColumn("low_confidence", F.lit(False)).withColumn("tiny_hole", F.lit(False))
    return done.select(
        *KEY, "dem_raw", F.col("reference").alias("dem"), F.col("reference").alias("dem_reference"), "dsm", *AUXILIARY, F.col("valid").alias("dem_valid_mask"), F.col("support").alias("dem_support_mask"),
        F.col("low_confidence").alias("dem_lowconf_mask"), F.col("tiny_hole").alias("dem_tinyhole_mask"), F.col("repair_weight").alias("dem_repair_weight"), F.col("confidence").alias("dem_confidence"),
    )


def _looked_at(part: DataFrame, method: str, sigma: float, distance: float, smoothing: int, radii, scale: float, ratio: str = "ground_penetration_ratio") -> DataFrame:
    """Adds to windows (as tiles of their own, with partial, mask and dsm) coarse, the terrain features of it, and the confidence map."""
    part = interpolate(part, "partial", method, sigma, distance, "coarse", smoothing)
    part = settled(boundary_band(openness(curvature(slope(part, "coarse"), "coarse"), "coarse", radii)))
    given = F.coalesce(F.col(ratio), F.lit(0.0)) if ratio in part.columns else F.lit(0.0)
    return confidence_map(part.withColumn("_ratio", given), ratio="_ratio", scale=scale, out="confidence_map").drop("_ratio")


def normalized_channels(part: DataFrame, channels: list[str] = CHANNELS, scales: dict[str, float] = SCALES, z: str = "z") -> DataFrame:
    """Adds channels (an array in the order asked for), c (a struct of the same by name), coarse_n, mean and std to windows.

    mean and std are those of the window's z; elevations are less the mean and divided by the spread, and the mean where they are missing.
    Densities, features and ratios are normalised by the kind that their name says; channels that the window lacks are 0.
    """
    named = part.withColumn("partial_dem", F.col("partial")).withColumn("coarse_dem", F.col("coarse"))
    features = [c for c in channels if KINDS.get(c) == "feature" and c in named.columns]
    sums = named.groupBy("tile").agg(
        F.coalesce(F.avg(z), F.lit(0.0)).alias("mean"), F.when(F.count(z) > 0, F.greatest(F.stddev_pop(z), F.lit(1e-6))).otherwise(1.0).alias("std"), *[F.avg(c).alias(f"_fill_{c}") for c in features]
    )
    out = with_tiles(named, sums)

    def value(name: str) -> Column:
        if name not in named.columns:
            return F.lit(0.0)
        x, kind, scale = F.col(name).cast("double"), KINDS.get(name), F.lit(float(scales.get(name, 0.0)))
        if kind == "dem":
            return normalize_dem(x, F.col("mean"), F.col("std"), F.col("mean"))
        if kind == "density":
            return normalize_density(x, scale)
        if kind == "ratio":
            return normalize_ratio(x)
        if kind == "feature":
            return normalize_feature(x, F.col(f"_fill_{name}"), scale)
        return F.coalesce(x, F.lit(0.0))

    out = out.withColumn("coarse_n", normalize_dem(F.col("coarse"), F.col("mean"), F.col("std"), F.col("mean")))
    out = out.withColumn("c", F.struct(*[value(c).alias(c) for c in channels])).withColumn("channels", F.array(*[F.col(f"c.{c}") for c in channels]))
    return out.drop(*[f"_fill_{c}" for c in features], "partial_dem", "coarse_dem")


def repair_tiles(cells: DataFrame, grids: DataFrame, predictor: Column, channels: list[str] = CHANNELS, scales: dict[str, float] = SCALES, size: int = 256, stride: int = 128, method: str = "idw", sigma: float = 0.0, distance: float = 64.0, smoothing: int = 1, radii=(3, 7, 15, 31), distance_scale: float = 24.0, out: str = "predicted") -> DataFrame:
    """(tile, row, col, out, covers): cells that aren't observed predicted window by window and blended; the others come back unchanged.

    cells: z, valid (observed; tile_sources gives both), dsm and whatever auxiliary bands there are. In a window that has cells which aren't valid
    these are masked, whether z is there or not; the rest is filled (coarse), terrain features and a confidence map are made of it,
    and all channels are normalised in the order asked for. predictor is any expression over channels (an array), c (a
    struct by name), coarse_n and mask, in normalised units. Windows of valid cells only skip all that.
    """
    w = settled(sample_ids(cut_windows(cells.withColumn("valid", F.coalesce("valid", F.lit(False))), grids, size, stride)))
    void = w.groupBy("sample_id").agg(F.count_if(~F.col("valid")).alias("_void"))
    w = w.join(void, "sample_id")
    whole = w.where("_void = 0").select(*KEY, F.col("z").alias("v"))
    bands = [c for c in cells.columns if c not in KEY]
    part = w.where("_void > 0").select(F.col("sample_id").alias("tile"), F.col("i").alias("row"), F.col("j").alias("col"), *bands, F.struct(*KEY).alias("at"))
    part = part.withColumn("mask", ~F.col("valid")).withColumn("partial", F.when(F.col("valid"), F.col("z")))
    part = normalized_channels(_looked_at(part, method, sigma, distance, smoothing, radii, distance_scale), channels, scales)
    done = part.select("at.*", F.when(F.col("mask"), predictor * F.col("std") + F.col("mean")).otherwise(F.col("z")).alias("v"))
    return blend(done.unionByName(whole), "v", out)


def build_samples(cells: DataFrame, grids: DataFrame, size: int = 256, stride: int = 128, least_valid: float = 0.95, mask_ratio=(0.03, 0.35), coverage=(0.05, 0.22), method: str = "idw", sigma: float = 0.0, distance: float = 64.0, smoothing: int = 1, radii=(3, 7, 15, 31), distance_scale: float = 24.0, seed: int = 0, **meta: Column) -> tuple[DataFrame, DataFrame]:
    """(cells of samples, samples) of rasters with bands dem, dsm and auxiliary ones.

    Windows are padded; those with too few valid cells go, the gaps of the others are filled. Each draws a strategy and gets simulated voids on what
    was valid; those with too few or too many masked cells go. Cells have sample_id, row and col in it, gt, partial, coarse, dsm, mask, reached (whether
    the voids met their target), confidence_map, features and the auxiliary bands; samples have sample_id, strategy, mask_ratio and meta, a JSON text. Draws follow from the sample's id and the seed.
    """
    full = nearest_fill(cells, "dsm", "_dsm").withColumn("dsm", F.col("_dsm")).drop("_dsm")
    w = settled(sample_ids(padded_windows(full, grids, size, stride)))
    enough = w.groupBy("sample_id", "tile", "top", "left").agg((F.count("dem") / F.lit(float(size * size))).alias("valid_ratio")).where(F.col("valid_ratio") >= least_valid)
    bands = [c for c in cells.columns if c not in KEY]
    part = w.join(enough.select("sample_id"), "sample_id", "left_semi").select(F.col("sample_id").alias("tile"), F.col("i").alias("row"), F.col("j").alias("col"), *bands)
    part = nearest_fill(nearest_fill(part.withColumn("_ok", F.col("dem").isNotNull()), "dem", "gt"), "dsm", "_dsm").withColumn("dsm", F.col("_dsm")).drop("dem", "_dsm")
    part = settled(part.withColumn("_weight", F.when(F.col("_ok"), F.coalesce("vegetation_density", F.lit(0.0))).otherwise(0.0) if "vegetation_density" in bands else F.lit(0.0)))
    drawn = settled(voids.choose_strategy(enough.select(F.col("sample_id").alias("tile")), seed))
    part = voids.voids_in_sequence(part.join(drawn, "tile"), None, coverage, "_ok", "_weight", seed, "mask")
    part = settled(part.drop("_weight", "_ok", "strategy"))
    ratio = part.groupBy("tile").agg(F.avg(F.col("mask").cast("double")).alias("mask_ratio")).where(F.col("mask_ratio").between(*mask_ratio))
    part = part.join(ratio.select("tile"), "tile", "left_semi").withColumn("partial", F.when(~F.col("mask"), F.col("gt")))
    part = _looked_at(part, method, sigma, distance, smoothing, radii, distance_scale)
    samples = enough.drop("valid_ratio").join(drawn.withColumnRenamed("tile", "sample_id"), "sample_id").join(ratio.withColumnRenamed("tile", "sample_id"), "sample_id")
    samples = with_meta(samples, mask_strategy=F.col("strategy"), mask_ratio=F.col("mask_ratio"), **meta).select("sample_id", "tile", "top", "left", "strategy", "mask_ratio", "meta")
    return part.withColumnRenamed("tile", "sample_id"), samples
