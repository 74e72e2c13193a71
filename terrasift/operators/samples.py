"""Samples and tiles as models see them: sources with fallbacks, padded windows, features, channel stacks, prediction by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import positions
from .components import settled
from .fill import fill_small_holes, interpolate
from .nearest import nearest_fill
from .stencil import boundary_band, curvature, openness, slope
from .tiles import with_tiles
from .tin import tin
from .windows import blend, cut_windows, sample_ids

KEY = ["tile", "row", "col"]


def stem(name: Column, suffix: str) -> Column:
    """A name without that end."""
    return F.when(F.endswith(name, F.lit(suffix)), F.substr(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def matched_tiles(left: DataFrame, right: DataFrame, what: str = "surface") -> DataFrame:
    """Tiles that both listings have; a tile that one lacks ends the query with an error that names it."""
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), "tile", "full")
    complete = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.where(F.assert_true(complete, F.concat(F.lit(f"no {what} of both kinds for tile "), F.col("tile").cast("string"))).isNull()).drop("_l", "_r")


def tile_metadata(cells: DataFrame, bands: list[str], resolution: float = 1.0) -> DataFrame:
    """(tile, height, width, resolution, bands): from the places alone."""
    size = cells.groupBy("tile").agg((F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width"))
    return size.select("tile", "height", "width", F.lit(float(resolution)).alias("resolution"), F.lit(len(bands)).alias("bands"))


def tile_sources(cells: DataFrame) -> DataFrame:
    """Adds z and valid. z is dem_raw in tiles that have any of it, else dem. valid: the valid mask of tiles that have one, else
    where there is ground density in tiles that have it, else where z is there. Columns that the table lacks count as absent."""
    has = {c: F.count(c) > 0 if c in cells.columns else F.lit(False) for c in ("dem_raw", "dem_valid_mask", "ground_density")}
    there = cells.groupBy("tile").agg(F.count(F.lit(1)).alias("_n"), *[h.alias(f"_has_{c}") if c in cells.columns else F.any_value(h).alias(f"_has_{c}") for c, h in has.items()])
    c = with_tiles(cells, there.drop("_n"))
    of = lambda name: F.col(name) if name in cells.columns else F.lit(None)
    c = c.withColumn("z", F.when(F.col("_has_dem_raw"), of("dem_raw")).otherwise(F.col("dem")).cast("double"))
    mask = F.when(F.col("_has_dem_valid_mask"), of("dem_valid_mask").cast("double") > 0.5).when(F.col("_has_ground_density"), of("ground_density") > 0).otherwise(F.col("z").isNotNull())
    return c.withColumn("valid", F.coalesce(mask, F.lit(False))).drop(*[f"_has_{x}" for x in has])


def terrain_features(cells: DataFrame, band: str = "z", radii=(3, 7, 15, 31)) -> DataFrame:
    """Adds slope, curvature and openness of a band whose missing cells are filled from the nearest first."""
    c = nearest_fill(cells, band, "_full")
    return openness(curvature(slope(c, "_full"), "_full"), "_full", radii).drop("_full")


def padded_windows(cells: DataFrame, grids: DataFrame, size: int, stride: int) -> DataFrame:
    """(tile, top, left, i, j, and the cell's columns): every place of every window; NULL beyond the raster."""
    starts = grids.select("tile", "width", F.explode(positions(F.col("height"), size, stride)).alias("top"))
    starts = starts.select("tile", "top", F.explode(positions(F.col("width"), size, stride)).alias("left"))
    places = starts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    places = places.withColumn("row", F.col("top") + F.col("i")).withColumn("col", F.col("left") + F.col("j"))
    return places.join(cells, KEY, "left")


def kept_by_mask_ratio(windows: DataFrame, keys: list[str], mask: str = "mask", least: float = 0.03, most: float = 0.35) -> DataFrame:
    """(keys, mask_ratio) of the windows whose share of masked cells lies between both bounds, these included."""
    share = F.avg(F.coalesce(F.col(mask), F.lit(False)).cast("double"))
    return windows.groupBy(*keys).agg(share.alias("mask_ratio")).where(F.col("mask_ratio").between(least, most))


def with_meta(samples: DataFrame, **more: Column) -> DataFrame:
    """Adds sample_id and meta, a JSON text with the sample's id, tile and place, and whatever else is given."""
    s = sample_ids(samples)
    fields = [F.col("sample_id"), F.col("tile").alias("tile_id"), F.col("top").alias("row"), F.col("left").alias("col")]
    return s.withColumn("meta", F.to_json(F.struct(*fields, *[c.alias(n) for n, c in more.items()])))


def channel_stack(cells: DataFrame, channels: list[str], partial: str = "partial", coarse: str = "coarse", absent: str = "error") -> DataFrame:
    """Adds channels, an array in the given order; missing cells of the partial surface come from the coarse one, other missing
    values are 0. absent: bands that the table lacks are an "error" or "zero"."""
    lacking = [c for c in channels if c not in cells.columns]
    if lacking and absent == "error":
        raise ValueError(f"missing bands: {', '.join(lacking)}")
    value = lambda c: F.lit(0.0) if c in lacking else F.coalesce(F.col(c), F.col(coarse)) if c == partial else F.col(c)
    return cells.withColumn("channels", F.array(*[F.coalesce(value(c).cast("double"), F.lit(0.0)) for c in channels]))


def denormalize(cells: DataFrame, scales: DataFrame, band: str, out: str) -> DataFrame:
    """band * std + mean by the tile's row (tile, mean, std) of the scales."""
    return with_tiles(cells, scales.select("tile", F.col("mean").alias("_mean"), F.col("std").alias("_std"))).withColumn(out, F.col(band) * F.col("_std") + F.col("_mean")).drop("_mean", "_std")


def patch_missing(cells: DataFrame, bands: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells with the bands filled from the nearest valid cell, report (tile, band, filled))."""
    gaps = cells.groupBy("tile").agg(*[F.count_if(F.col(b).isNull()).alias(b) for b in bands])
    report = gaps.unpivot(["tile"], bands, "band", "filled")
    out = cells
    for b in bands:
        out = nearest_fill(out, b, "_full").withColumn(b, F.col("_full")).drop("_full")
    return out, report


def band_table(cells: DataFrame, bands: list[str]) -> DataFrame:
    """(tile, row, col, band, value): one row per cell and band, to be written by band."""
    return cells.select(*KEY, *[F.col(b).cast("double").alias(b) for b in bands]).unpivot(KEY, bands, "band", "value")


def tin_surface(points: DataFrame, grids: DataFrame, cells: DataFrame, max_edge: float = 20.0, hole_area: int = 32, distance: float = 48.0, smoothing: int = 1) -> DataFrame:
    """The reference surface by triangles: their heights, small holes from the nearest cell, what is left by inverse distance.

    Adds tin, reference, valid (observed), support, confidence (1 observed, 0.7 under a triangle, else 0) and repair_weight (1 where no triangle is).
    """
    c = cells.join(tin(points, grids, max_edge).select(*KEY, F.col("z").alias("tin")), KEY, "left")
    c = fill_small_holes(settled(c), "tin", hole_area, "_some")
    c = interpolate(c, "_some", "idw", radius=distance, out="reference", smoothing=smoothing).drop("_some")
    observed, covered = F.col("dem").isNotNull(), F.col("tin").isNotNull()
    c = c.withColumn("valid", observed).withColumn("support", (F.col("all_density") > 0) | covered)
    c = c.withColumn("confidence", F.when(observed, 1.0).when(covered, 0.7).otherwise(0.0))
    return c.withColumn("repair_weight", F.when(covered, 0.0).otherwise(1.0))


def predict_tiles(cells: DataFrame, grids: DataFrame, predictor: Column, size: int = 256, stride: int = 128, method: str = "idw", distance: float = 64.0, smoothing: int = 1, radii=(3, 7, 15, 31), band: str = "z", out: str = "predicted") -> DataFrame:
    """(tile, row, col, out, covers): void cells predicted window by window and blended; valid cells come back unchanged.

    In each window that misses cells these are filled (coarse), slope, curvature, openness and the boundary band of the
    coarse surface are added, and the predictor, any expression over those columns, gives the void cells. Windows
    without missing cells skip all that.
    """
    w = sample_ids(cut_windows(cells, grids, size, stride)).select("tile", "row", "col", "i", "j", "sample_id", F.col(band).alias("z"))
    w = settled(w)
    void = w.groupBy("sample_id").agg(F.count_if(F.col("z").isNull()).alias("_void"))
    w = w.join(void, "sample_id")
    whole = w.where("_void = 0").select(*KEY, F.col("z").alias("v"))
    # a window is a tile of its own for fills and stencils
    part = w.where("_void > 0").select(F.col("sample_id").alias("tile"), F.col("i").alias("row"), F.col("j").alias("col"), "z", F.struct(*KEY).alias("at"))
    part = part.withColumn("mask", F.col("z").isNull())
    part = interpolate(part, "z", method, radius=distance, out="coarse", smoothing=smoothing)
    part = boundary_band(openness(curvature(slope(part, "coarse"), "coarse"), "coarse", radii))
    done = part.select("at.*", F.when(F.col("mask"), predictor).otherwise(F.col("z")).alias("v"))
    return blend(done.unionByName(whole), "v", out)
