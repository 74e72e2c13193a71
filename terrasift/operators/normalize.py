"""Model inputs: per-sample scales and normalised channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalize_dem, normalize_density, normalize_feature, normalize_ratio
from .tiles import with_tiles


def dem_scale(cells: DataFrame, band: str) -> DataFrame:
    """(tile, mean, std): population standard deviation, 1 where it is next to nothing; 0 and 1 without valid cells."""
    s = cells.groupBy("tile").agg(F.avg(band).alias("mean"), F.stddev_pop(band).alias("std"))
    return s.select("tile", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(F.col("std") > 1e-6, F.col("std")).otherwise(1.0).alias("std"))


def density_scale(cells: DataFrame, band: str) -> DataFrame:
    """(tile, scale): the 99th percentile of log(1 + x)."""
    return cells.groupBy("tile").agg(F.percentile(F.log1p(F.greatest(F.col(band), F.lit(0.0))), 0.99).alias("scale"))


def feature_scale(cells: DataFrame, band: str) -> DataFrame:
    """(tile, fill, scale): the mean, and the 95th percentile of the absolute value."""
    return cells.groupBy("tile").agg(F.avg(band).alias("fill"), F.percentile(F.abs(F.col(band)), 0.95).alias("scale"))


def channel(cells: DataFrame, band: str, kind: str, out: str) -> DataFrame:
    """Adds one normalised channel; kind: dem, density, feature or ratio."""
    if kind == "ratio":
        return cells.withColumn(out, normalize_ratio(F.col(band)))
    if kind == "dem":
        return with_tiles(cells, dem_scale(cells, band)).withColumn(out, normalize_dem(F.col(band), F.col("mean"), F.col("std"), F.col("mean"))).drop("mean", "std")
    if kind == "density":
        return with_tiles(cells, density_scale(cells, band)).withColumn(out, normalize_density(F.col(band), F.coalesce("scale", F.lit(1.0)))).drop("scale")
    if kind == "feature":
        return with_tiles(cells, feature_scale(cells, band)).withColumn(out, normalize_feature(F.col(band), F.col("fill"), F.coalesce("scale", F.lit(1.0)))).drop("fill", "scale")
    raise ValueError(f"unknown kind {kind!r}")


def to_blocks(cells: DataFrame, bands: list[str]) -> DataFrame:
    """One row per tile with each band as a row-major array: the layout of samples. Tiles are windows of bounded size here."""
    c = cells.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("row", "col", *bands))).alias("c"))
    return c.select("tile", *[F.col(f"c.{b}").alias(b) for b in bands])


def from_blocks(samples: DataFrame, bands: list[str], width: int) -> DataFrame:
    """Back to one row per cell."""
    c = samples.select("tile", F.posexplode(F.arrays_zip(*bands)).alias("p", "b"))
    return c.select("tile", F.floor(F.col("p") / width).cast("int").alias("row"), (F.col("p") % width).alias("col"), *[f"b.{b}" for b in bands])
