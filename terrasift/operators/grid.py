"""Points to grids: tile headers, grid geometry, one aggregation per cell, dense spine.

The aggregation combines partially in each task, so one shuffle moves at most a row per occupied
cell and task, however many points share a cell. The grid side is one row per tile, joined by with_tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import penetration
from .components import settled
from .tiles import with_tiles

GROUND, VEGETATION, BUILDING = 2, 5, 6
KEY = ["tile", "row", "col"]


def tile_headers(points: DataFrame) -> DataFrame:
    """One row per tile: number of points and bounds."""
    return points.groupBy("tile").agg(F.count("*").alias("point_count"), *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"])


def class_histogram(points: DataFrame) -> DataFrame:
    return points.groupBy("tile", "cls").agg(F.count("*").alias("n"))


def class_masks(points: DataFrame, classes: dict[str, int]) -> DataFrame:
    """A boolean column per class."""
    return points.select("*", *[(F.col("cls") == v).alias(f"is_{k}") for k, v in classes.items()])


def grid_specs(headers: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Geometry of each tile: its first cell centre lies on a multiple of the resolution."""
    r = F.lit(float(resolution))
    g = headers.withColumn("center_min_x", F.floor(F.col("min_x") / r) * r).withColumn("center_max_y", F.ceil(F.col("max_y") / r) * r)
    width = F.greatest(F.floor((F.col("max_x") - F.col("center_min_x")) / r) + 1, F.lit(1)).cast("int")
    height = F.greatest(F.floor((F.col("center_max_y") - F.col("min_y")) / r) + 1, F.lit(1)).cast("int")
    return g.select("tile", "center_min_x", "center_max_y", (F.col("center_min_x") - r / 2).alias("west"), (F.col("center_max_y") + r / 2).alias("north"), width.alias("width"), height.alias("height"))


def to_cells(points: DataFrame, grids: DataFrame, resolution: float = 1.0, computed: bool = False) -> DataFrame:
    """Points with their row (0 is north) and col; points beyond the last whole cell are dropped."""
    r = F.lit(float(resolution))
    at = with_tiles(points, grids, computed).withColumn("col", F.floor((F.col("x") - F.col("west")) / r).cast("int")).withColumn("row", F.floor((F.col("north") - F.col("y")) / r).cast("int"))
    return at.where("row >= 0 and row < height and col >= 0 and col < width").select(*points.columns, "row", "col")


def spine(grids: DataFrame) -> DataFrame:
    """Every cell of every grid."""
    rows = grids.select("tile", "width", F.explode(F.expr("sequence(0, height - 1)")).alias("row"))
    return rows.select("tile", "row", F.explode(F.expr("sequence(0, width - 1)")).alias("col"))


def rasterize(points: DataFrame, grids: DataFrame, value: str, how: str, fill: float | None = None, resolution: float = 1.0) -> DataFrame:
    """One band v over all cells. Empty cells: 0 for count and sum, fill for mean and max."""
    kinds = {"count": F.count("*").cast("double"), "sum": F.sum(value), "mean": F.avg(value), "max": F.max(value)}
    if how not in kinds:
        raise ValueError(f"how is one of {sorted(kinds)}")
    grids = settled(grids)
    per = to_cells(points, grids, resolution, computed=True).groupBy(*KEY).agg(kinds[how].alias("v"))
    empty = F.lit(0.0) if how in ("count", "sum") else F.lit(fill).cast("double")
    return spine(grids).join(per, KEY, "left").withColumn("v", F.coalesce("v", empty))


def cell_bands(points: DataFrame, grids: DataFrame, resolution: float = 1.0) -> DataFrame:
    """All bands that come from points of the surface classes, over all cells, in one aggregation."""
    area = F.lit(float(resolution) ** 2)
    surface = points.where(F.col("cls").isin(GROUND, VEGETATION, BUILDING))
    count = lambda c: F.count(F.when(F.col("cls") == c, 1))
    grids = settled(grids)
    per = to_cells(surface, grids, resolution, computed=True).groupBy(*KEY).agg(
        F.count("*").alias("n"), count(GROUND).alias("n_ground"), count(VEGETATION).alias("n_vegetation"), count(BUILDING).alias("n_building"),
        F.avg(F.when(F.col("cls") == GROUND, F.col("z"))).alias("dem"), F.max("z").alias("dsm"), F.avg("intensity").alias("mean_intensity"),
        F.avg("return_num").alias("mean_return_num"), F.avg((F.col("return_num") == F.col("num_returns")).cast("double")).alias("last_return_ratio"),
    )
    dense = spine(grids).join(per, KEY, "left")
    for n, band in (("n", "all_density"), ("n_ground", "ground_density"), ("n_vegetation", "vegetation_density"), ("n_building", "building_density")):
        dense = dense.withColumn(band, F.coalesce(F.col(n), F.lit(0)) / area)
    dense = dense.withColumn("last_return_ratio", F.coalesce("last_return_ratio", F.lit(0.0))).withColumn("ground_penetration_ratio", penetration(F.col("ground_density"), F.col("all_density")))
    return dense.withColumn("dem_valid_mask", F.col("ground_density") > 0).drop("n", "n_ground", "n_vegetation", "n_building")


def tile_stats(cells: DataFrame) -> DataFrame:
    """Counts per tile; unresolved is a difference of counts."""
    c = cells.groupBy("tile").agg(F.count("*").alias("n_cells"), F.count_if(F.col("all_density") > 0).alias("support"), F.count("dem").alias("valid"), F.count("dsm").alias("surface"), F.max("dsm").alias("max_dsm"), F.min("dem").alias("min_dem"))
    return c.withColumn("unresolved", F.greatest(F.col("support") - F.col("valid"), F.lit(0)).cast("bigint"))


def tile_summary(points: DataFrame, cells: DataFrame, support: str = "support", low: str = "low_confidence", tiny: str = "tiny_hole", reference: str = "reference") -> DataFrame:
    """Twelve counters per tile, from one aggregation of its points and one of its cells. A tile without any point of
    the surface classes, or without ground, ends the query with an error that names it."""
    surface = F.col("cls").isin(GROUND, VEGETATION, BUILDING)
    p = points.groupBy("tile").agg(F.count("*").alias("total_points"), F.count_if(surface).alias("surface_points"), F.count_if(F.col("cls") == GROUND).alias("ground_points"))
    c = cells.groupBy("tile").agg(
        (F.max("col") + 1).cast("int").alias("grid_width"), (F.max("row") + 1).cast("int").alias("grid_height"), F.count("dem").alias("observed_cells"),
        F.count_if(F.col("dem").isNull()).alias("missing_cells"), F.count_if(support).alias("support_cells"), F.count_if(low).alias("low_confidence_cells"),
        F.count_if(tiny).alias("tiny_hole_cells"), F.count(reference).alias("reference_cells"),
    )
    both = c.join(p, "tile").withColumn("unresolved_cells", F.greatest(F.col("support_cells") - F.col("reference_cells"), F.lit(0)).cast("bigint"))
    named = lambda what: F.concat(F.lit(f"no {what} points in tile "), F.col("tile").cast("string"))
    return both.where(F.assert_true(F.col("surface_points") > 0, named("surface")).isNull() & F.assert_true(F.col("ground_points") > 0, named("ground")).isNull())
