"""Data-quality rules over cells: one row per violation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DENSITIES = ["all_density", "ground_density", "vegetation_density", "building_density"]
RATIOS = ["last_return_ratio", "ground_penetration_ratio"]
CORE, AUXILIARY = ["dem", "dsm"], ["mean_intensity", "mean_return_num"]


def missing_bands(cells: DataFrame, bands: list[str]) -> list[str]:
    """Names that the table lacks."""
    return [b for b in bands if b not in cells.columns]


def violations(cells: DataFrame, core=CORE, auxiliary=AUXILIARY, densities=DENSITIES, ratios=RATIOS) -> DataFrame:
    """(tile, rule, severity, raster, value), from one aggregation per tile."""
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    stats = {f"lack_{b}": share(F.col(b).isNull()) for b in (*core, *auxiliary)}
    stats |= {f"min_{b}": F.min(b) for b in (*densities, *ratios, *core)} | {f"max_{b}": F.max(b) for b in (*ratios, *core)}
    stats["below"] = F.count_if(F.col("dsm") < F.col("dem") - 1) / F.count(F.lit(1))
    s = cells.groupBy("tile").agg(*[v.alias(k) for k, v in stats.items()])
    rules = [("missing_core", "error", b, F.col(f"lack_{b}"), F.col(f"lack_{b}") > 0) for b in core]
    rules += [("missing_most", "error", b, F.col(f"lack_{b}"), F.col(f"lack_{b}") > 0.5) for b in auxiliary]
    rules += [("missing_some", "warning", b, F.col(f"lack_{b}"), (F.col(f"lack_{b}") > 0.05) & (F.col(f"lack_{b}") <= 0.5)) for b in auxiliary]
    rules += [("negative_density", "error", b, F.col(f"min_{b}"), F.col(f"min_{b}") < 0) for b in densities]
    rules += [("ratio_low", "error", b, F.col(f"min_{b}"), F.col(f"min_{b}") < -0.01) for b in ratios]
    rules += [("ratio_high", "error", b, F.col(f"max_{b}"), F.col(f"max_{b}") > 1.01) for b in ratios]
    rules += [("span", "warning", b, F.col(f"max_{b}") - F.col(f"min_{b}"), F.col(f"max_{b}") - F.col(f"min_{b}") > 5000) for b in core]
    rules += [("deep", "warning", b, F.col(f"min_{b}"), F.col(f"min_{b}") < -500) for b in core]
    rules.append(("dsm_below_dem", "warning", "dsm", F.col("below"), F.col("below") > 0.1))
    found = F.array(*[F.when(hit, F.struct(F.lit(r).alias("rule"), F.lit(sev).alias("severity"), F.lit(b).alias("raster"), v.cast("double").alias("value"))) for r, sev, b, v, hit in rules])
    return s.select("tile", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v")).select("tile", "v.*")


def shape_violations(bands: DataFrame, core: list[str]) -> DataFrame:
    """(tile, rule, raster) from rows (tile, row, col, band): bands of a tile that aren't there, and bands of another shape than the first of core."""
    shapes = bands.groupBy("tile", "band").agg(F.struct(F.max("row"), F.max("col")).alias("shape"))
    tiles = shapes.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("band", "shape"))).alias("has"))
    of = lambda b: F.element_at("has", F.lit(b))
    lacking = [F.when(of(b).isNull(), F.struct(F.lit("lacking").alias("rule"), F.lit(b).alias("raster"))) for b in core]
    odd = [F.when(of(b) != of(core[0]), F.struct(F.lit("shape").alias("rule"), F.lit(b).alias("raster"))) for b in core[1:]]
    found = F.filter(F.array(*lacking, *odd), lambda x: x.isNotNull())
    return tiles.select("tile", F.explode(found).alias("v")).select("tile", "v.*")


def status(tiles: DataFrame, found: DataFrame) -> DataFrame:
    """(tile, status): FAIL with any error, WARN with any warning, else OK."""
    worst = found.groupBy("tile").agg(F.max((F.col("severity") == "error").cast("int")).alias("e"))
    return tiles.select("tile").distinct().join(worst, "tile", "left").select("tile", F.when(F.col("e") == 1, "FAIL").when(F.col("e") == 0, "WARN").otherwise("OK").alias("status"))
