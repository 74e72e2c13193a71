"""The library's queries by name. Each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import components, composites, fill, grid, metrics, nearest, normalize, quality, repair, samples, stencil, tin, training, voids, windows
from ..sources import las, raster, tables
from ..sources.views import embedding_patches, lineitem_points
from ..streaming import cells as stream

QUERIES: dict = {}
KEY = ["tile", "row", "col"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r(name: str, c=None, digits: int = 6):
    """A rounded double without a negative zero. Halves are those of the double times the power of ten, as in DuckDB, and not of its shortest decimals."""
    power = 10.0**digits
    return (F.round((F.col(name) if c is None else c) * power) / power + F.lit(0.0)).alias(name)


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid_specs(grid.tile_headers(lineitem_points(spark, sf_dir)))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cell_bands(lineitem_points(spark, sf_dir), _grids(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches with a prediction: the patch turned by a quarter of its own value where it is masked."""
    p = embedding_patches(spark, sf_dir)
    return p.withColumn("gt", F.col("z")).withColumn("pred", F.when(F.col("mask"), F.col("z") * 0.75).otherwise(F.col("z") + 0.125)).withColumn("first", F.col("z") * 0.5)


# points to cells


@query
def class_histogram(spark, sf_dir):
    return grid.class_histogram(lineitem_points(spark, sf_dir))


@query
def class_masks(spark, sf_dir):
    m = grid.class_masks(lineitem_points(spark, sf_dir), {"ground": 2, "vegetation": 5, "building": 6})
    return m.groupBy("tile").agg(*[F.count_if(f"is_{k}").alias(f"n_{k}") for k in ("ground", "vegetation", "building")])


@query
def tile_headers(spark, sf_dir):
    return grid.tile_headers(lineitem_points(spark, sf_dir))


@query
def grid_spec(spark, sf_dir):
    return _grids(spark, sf_dir)


@query
def cell_stats(spark, sf_dir):
    return _cells(spark, sf_dir).select(*KEY, "all_density", "ground_density", "vegetation_density", "building_density", _r("dem"), "dsm", _r("mean_intensity"), _r("mean_return_num"), _r("last_return_ratio"), _r("ground_penetration_ratio"), "dem_valid_mask")


def _raster(how: str, value: str):
    def run(spark, sf_dir):
        return grid.rasterize(lineitem_points(spark, sf_dir).where("cls = 2"), _grids(spark, sf_dir), value, how).select(*KEY, _r("v"))

    return run


for _how, _value in (("count", "z"), ("sum", "z"), ("mean", "z"), ("max", "intensity")):
    QUERIES[f"rasterize_{_how}"] = _raster(_how, _value)


@query
def tile_stats(spark, sf_dir):
    return grid.tile_stats(_cells(spark, sf_dir)).select("tile", "n_cells", "support", "valid", "surface", "max_dsm", _r("min_dem"), "unresolved")


@query
def source_precedence(spark, sf_dir):
    """Per tile of a listing with repeats, the reference surface if there is one, else the default."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    listing = p.select((F.col("p_partkey") % 50).cast("string").alias("tile"), F.when(F.col("p_partkey") % 3 == 0, "reference").otherwise("default").alias("source")).distinct()
    return tables.first_source(listing, ["reference", "default"])


@query
def skip_done(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("tile"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("tile"))
    return tables.not_done(c, o, ["tile"])


@query
def nodata_round_trip(spark, sf_dir):
    p = embedding_patches(spark, sf_dir).withColumn("v", F.when(F.col("mask"), float("nan")).otherwise(F.col("z")))
    p = p.withColumn("stored", fx.to_nodata(F.col("v")))
    return p.select(*KEY, _r("stored"), _r("back", fx.from_nodata(F.col("stored"))))


@query
def hole_mask(spark, sf_dir):
    p = embedding_patches(spark, sf_dir).withColumn("v", fx.from_nodata(F.when(F.col("mask"), -9999.0).otherwise(F.col("z"))))
    return p.groupBy("tile").agg(F.count_if(F.col("v").isNull()).alias("holes"), F.count_if(F.col("v").isNotNull()).alias("valid"))


@query
def quality_rules(spark, sf_dir):
    return quality.violations(_cells(spark, sf_dir)).select("tile", "rule", "severity", "raster", _r("value"))


@query
def quality_status(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return quality.status(c, quality.violations(c))


# neighbourhoods


@query
def slope(spark, sf_dir):
    return stencil.slope(embedding_patches(spark, sf_dir)).select(*KEY, _r("slope"))


@query
def curvature(spark, sf_dir):
    return stencil.curvature(embedding_patches(spark, sf_dir)).select(*KEY, _r("curvature"))


@query
def openness_multi(spark, sf_dir):
    return stencil.openness(embedding_patches(spark, sf_dir), radii=(3, 7, 15, 31)).select(*KEY, *[_r(f"openness_s{i}") for i in range(1, 5)])


@query
def neighbor_count(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return stencil.neighbor_count(c, "dem_valid_mask").select(*KEY, "neighbors")


@query
def boundary_band(spark, sf_dir):
    return stencil.boundary_band(embedding_patches(spark, sf_dir), inner=1, outer=2).select(*KEY, "boundary_band")


@query
def dilate(spark, sf_dir):
    return stencil.dilate(_cells(spark, sf_dir), "dem_valid_mask", 2, "near_ground").select(*KEY, "near_ground")


@query
def median_filter(spark, sf_dir):
    return stencil.median3(embedding_patches(spark, sf_dir)).select(*KEY, _r("median"))


def _wide_median(size: int):
    def run(spark, sf_dir):
        return stencil.median(_holes(spark, sf_dir), "dem", size).select(*KEY, _r("median"))

    return run


for _size in (5, 7):
    QUERIES[f"median_filter_{_size}"] = _wide_median(_size)


@query
def gaussian_filter(spark, sf_dir):
    return stencil.gaussian(embedding_patches(spark, sf_dir), sigma=0.5).select(*KEY, _r("smooth"))


@query
def terrain_stack(spark, sf_dir):
    """Slope, curvature, openness and boundary band of the filled cells, masked where they were missing, in one plan."""
    c = nearest.nearest_fill(_cells(spark, sf_dir), "dem", "z").withColumn("mask", F.col("dem").isNull()).select(*KEY, "z", "mask")
    s = stencil.boundary_band(stencil.openness(stencil.curvature(stencil.slope(c)), radii=(3, 7, 15, 31)), inner=2, outer=2)
    return s.select(*KEY, _r("z"), _r("slope"), _r("curvature"), *[_r(f"openness_s{i}") for i in range(1, 5)], "mask", "boundary_band")


# distance, holes, filling


@query
def edt(spark, sf_dir):
    return nearest.nearest_valid(_cells(spark, sf_dir), "dem").select(*KEY, _r("distance"))


@query
def nearest_fill(spark, sf_dir):
    return nearest.nearest_fill(_cells(spark, sf_dir), "dem").select(*KEY, _r("filled"))


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches that miss their positive cells."""
    return embedding_patches(spark, sf_dir).withColumn("dem", F.when(F.col("z") <= 0, F.col("z")))


@query
def idw_fill(spark, sf_dir):
    return nearest.inverse_distance(_holes(spark, sf_dir), "dem", radius=2).select(*KEY, _r("idw"))


@query
def search_fill(spark, sf_dir):
    """The wide voids of the cells from the nearest cells of four quarters within 64, smoothed once."""
    return nearest.search_fill(_cells(spark, sf_dir), "dem", 64, 1).select(*KEY, _r("filled", F.col("idw")))


@query
def label_components(spark, sf_dir):
    c = components.label_components(_holes(spark, sf_dir).withColumn("hole", F.col("dem").isNull()), "hole")
    return c.where("label is not null").groupBy("tile", "label").agg(F.count("*").alias("area"))


@query
def fill_small_holes(spark, sf_dir):
    return fill.fill_small_holes(_holes(spark, sf_dir), "dem", 8).select(*KEY, _r("filled"))


@query
def promote_gaps(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("observed", F.col("dem").isNotNull()).withColumn("support", F.col("all_density") > 1)
    return fill.promote_small_gaps(c).select(*KEY, "promoted")


@query
def tiny_holes(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("domain", F.col("all_density") > 0)
    return fill.tiny_holes(c, "dem", "domain").select(*KEY, "tiny_hole")


@query
def reference_dem(spark, sf_dir):
    done = fill.reference_dem(_cells(spark, sf_dir), support=F.col("all_density") > 0)
    return done.select(*KEY, _r("reference"), "valid", "support", "low_confidence", "filled", "tiny_hole", _r("repair_weight"), _r("confidence"))


@query
def confidence_map(spark, sf_dir):
    p = embedding_patches(spark, sf_dir).withColumn("partial", F.when(~F.col("mask"), F.col("z"))).withColumn("dsm", F.col("z") * 2).withColumn("coarse", F.col("z")).withColumn("ratio", F.abs(F.col("z")))
    return fill.confidence_map(p).select(*KEY, _r("confidence"))


@query
def display_stretch(spark, sf_dir):
    """Grey values; the doubles behind them are the same in both engines, as the tile's percentiles are."""
    return fill.display_stretch(embedding_patches(spark, sf_dir)).select(*KEY, "grey")


# windows


@query
def sliding_positions(spark, sf_dir):
    return windows.sample_ids(windows.window_starts(_grids(spark, sf_dir), 32, 24)).select("tile", "top", "left", "sample_id")


@query
def window_validity(spark, sf_dir):
    c, g = _cells(spark, sf_dir), _grids(spark, sf_dir)
    return windows.window_validity(windows.cut_windows(c, g, 32, 24), "dsm", 32, 0.5).select("tile", "top", "left", _r("valid_ratio"))


@query
def window_blend(spark, sf_dir):
    c, g = _cells(spark, sf_dir), _grids(spark, sf_dir)
    w = windows.cut_windows(c, g, 32, 24).withColumn("v", F.col("dsm") + F.col("i") - F.col("j"))
    return windows.blend(w, "v").select(*KEY, _r("blended"), "covers")


@query
def flip(spark, sf_dir):
    return windows.flip(embedding_patches(spark, sf_dir), horizontal=True, vertical=True).select(*KEY, _r("z"))


@query
def block_round_trip(spark, sf_dir):
    return normalize.from_blocks(normalize.to_blocks(embedding_patches(spark, sf_dir), ["z", "mask"]), ["z", "mask"], 8).select(*KEY, _r("z"), "mask")


# voids


@query
def void_strategy(spark, sf_dir):
    return voids.choose_strategy(embedding_patches(spark, sf_dir).select("tile").distinct())


def _void(strategy: str):
    def run(spark, sf_dir):
        p = embedding_patches(spark, sf_dir).withColumn("weight", F.floor(F.abs(F.col("z")) * 64))
        return voids.simulate_voids(p, strategy, shapes=8, radius=(1, 3), weight="weight").select(*KEY, "void")

    return run


for _s in voids.STRATEGIES:
    QUERIES[f"void_{_s}"] = _void(_s)


@query
def voids_in_sequence(spark, sf_dir):
    """Windows of 32 cells, voids with the shipped radii, the strategy drawn for each; one row each."""
    w = windows.sample_ids(windows.cut_windows(_cells(spark, sf_dir), _grids(spark, sf_dir), 32, 16))
    w = w.select(F.col("sample_id").alias("tile"), F.col("i").alias("row"), F.col("j").alias("col"), F.col("dsm").isNotNull().alias("ok"), "vegetation_density")
    w = voids.voids_in_sequence(voids.choose_strategy(w), None, valid="ok", weight="vegetation_density")
    return w.groupBy("tile", "strategy", "reached").agg(F.count_if("ok").alias("valid"), F.count_if("void").alias("void"), F.sum(F.when(F.col("void"), F.col("row") * 32 + F.col("col"))).alias("places"))


@query
def void_points_poisson(spark, sf_dir):
    return voids.void_points(embedding_patches(spark, sf_dir), "z", "mask", 2.0).select(*KEY, "i", _r("x"), _r("y"), _r("z"))


# normalisation, metrics, losses


@query
def normalize_dem(spark, sf_dir):
    p = embedding_patches(spark, sf_dir).withColumn("z", F.when(~F.col("mask"), F.col("z")))
    return normalize.channel(p, "z", "dem", "out").select(*KEY, _r("out"))


@query
def normalize_density(spark, sf_dir):
    return normalize.channel(_cells(spark, sf_dir), "all_density", "density", "out").select(*KEY, _r("out"))


@query
def normalize_feature(spark, sf_dir):
    p = embedding_patches(spark, sf_dir).withColumn("z", F.when(~F.col("mask"), F.col("z") * 8))
    return normalize.channel(p, "z", "feature", "out").select(*KEY, _r("out"))


@query
def normalize_ratio(spark, sf_dir):
    return normalize.channel(embedding_patches(spark, sf_dir), "z", "ratio", "out").select(*KEY, _r("out"))


@query
def masked_mae_rmse(spark, sf_dir):
    return metrics.masked_errors(_pairs(spark, sf_dir)).select("tile", *[_r(c) for c in ("mae", "rmse", "mask_mae", "mask_rmse")])


@query
def slope_rmse(spark, sf_dir):
    return metrics.slope_rmse(_pairs(spark, sf_dir)).select("tile", _r("slope_rmse"))


@query
def masked_l1(spark, sf_dir):
    return metrics.masked_l1(_pairs(spark, sf_dir)).select("tile", _r("hole_l1"), _r("valid_l1"), _r("l1"))


@query
def grad_loss(spark, sf_dir):
    return metrics.grad_loss(_pairs(spark, sf_dir)).select("tile", _r("grad_loss"))


@query
def curvature_loss(spark, sf_dir):
    return metrics.curvature_loss(_pairs(spark, sf_dir)).select("tile", _r("curvature_loss"))


@query
def total_loss(spark, sf_dir):
    return metrics.total_loss(_pairs(spark, sf_dir), weights=(1.0, 0.1, 0.2, 0.5)).select("tile", _r("loss"))


@query
def adversarial_losses(spark, sf_dir):
    p = embedding_patches(spark, sf_dir).select(F.col("z").alias("real"), (F.col("z") / 2).alias("fake"))
    return metrics.adversarial_losses(p).select(_r("generator_loss"), _r("discriminator_loss"))


@query
def eval_rollup(spark, sf_dir):
    return metrics.eval_rollup(_pairs(spark, sf_dir), F.floor(F.col("tile") / 16)).select("scope", *[_r(c) for c in ("mae", "rmse", "mask_mae", "mask_rmse")])


# samples, tiles as models see them


@query
def tile_metadata(spark, sf_dir):
    return samples.tile_metadata(_cells(spark, sf_dir), ["dem", "dsm"])


@query
def matched_tiles(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = lambda end: F.concat(F.lit("t"), F.col("p_partkey").cast("string"), F.lit(end))
    listing = lambda end: p.select(samples.stem(name(end), end).alias("tile"), name(end).alias(end.strip("_")))
    return samples.matched_tiles(listing("_dem"), listing("_dsm"))


@query
def tile_sources(spark, sf_dir):
    """Patches, every second of which has the surface with voids, and every third of which has a valid mask."""
    p = embedding_patches(spark, sf_dir).withColumn("dem", F.col("z"))
    p = p.withColumn("dem_raw", F.when((F.col("tile") % 2 == 0) & ~F.col("mask"), F.col("z") * 2))
    p = p.withColumn("dem_valid_mask", F.when(F.col("tile") % 3 == 0, (F.col("col") > 3).cast("double"))).drop("z")
    return samples.tile_sources(p).select(*KEY, _r("z"), "valid")


@query
def terrain_features(spark, sf_dir):
    c = samples.terrain_features(_cells(spark, sf_dir), "dem", radii=(3, 7))
    return c.select(*KEY, _r("slope"), _r("curvature"), _r("openness_s1"), _r("openness_s2"))


@query
def patch_missing(spark, sf_dir):
    done, report = samples.patch_missing(_cells(spark, sf_dir).select(*KEY, "dsm", "mean_intensity"), ["dsm", "mean_intensity"])
    sums = done.groupBy("tile").agg(F.sum("dsm").alias("dsm"), F.sum("mean_intensity").alias("mean_intensity"))
    return report.join(sums.unpivot(["tile"], ["dsm", "mean_intensity"], "band", "total"), ["tile", "band"]).select("tile", "band", "filled", _r("total", digits=3))


@query
def patch_in_place(spark, sf_dir):
    """A table of cells by tile whose gaps are filled in it; what is there afterwards."""
    path = f"{components.shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    tables.write_cells(_cells(spark, sf_dir), path, ["dsm", "mean_intensity"])
    tables.patch_in_place(spark, path, ["dsm", "mean_intensity"])
    done = spark.read.schema("row int, col int, dsm double, mean_intensity double, tile string").parquet(path)
    return done.select(*KEY, "dsm", _r("mean_intensity"))


@query
def written_counters(spark, sf_dir):
    """Counters of the pass that writes the cells; one row."""
    path, bands = f"{components.shared_dir(spark)}/cells-{uuid.uuid4().hex}", ["dem", "dsm", "mean_return_num"]
    seen = tables.write_observed(_cells(spark, sf_dir), path, tables.cell_counters(bands))
    return spark.read.parquet(path).limit(1).select(*[F.lit(v).cast("long").alias(n) for n, v in seen.items()])


@query
def band_table(spark, sf_dir):
    return samples.band_table(embedding_patches(spark, sf_dir).withColumn("m", F.col("mask").cast("double")), ["z", "m"]).select(*KEY, "band", _r("value"))


@query
def shape_rules(spark, sf_dir):
    """Patches of which some lack a band and some its last row."""
    b = samples.band_table(embedding_patches(spark, sf_dir).withColumn("m", F.col("mask").cast("double")), ["z", "m"])
    b = b.where("not (band = 'm' and (tile % 7 = 0 or (tile % 5 = 0 and row = 7)))")
    return quality.shape_violations(b, ["z", "m"])


@query
def mask_coverage(spark, sf_dir):
    p = embedding_patches(spark, sf_dir).withColumn("mask", F.col("mask") & (F.col("z") > 0))
    return metrics.mask_coverage(p).select("tile", _r("coverage"))


@query
def mask_ratio_filter(spark, sf_dir):
    p = embedding_patches(spark, sf_dir).withColumn("mask", F.col("mask") & (F.col("z") > 0))
    return samples.kept_by_mask_ratio(p, ["tile"], least=0.05, most=0.125).select("tile", _r("mask_ratio"))


@query
def dem_metrics(spark, sf_dir):
    return metrics.dem_metrics(_pairs(spark, sf_dir)).select("tile", *[_r(c) for c in ("mae", "rmse", "mask_mae", "mask_rmse", "slope_rmse")])


@query
def denormalize_dem(spark, sf_dir):
    """Normalised by the scale of what isn't masked, halved, and brought back."""
    p = embedding_patches(spark, sf_dir).withColumn("seen", F.when(~F.col("mask"), F.col("z")))
    half = normalize.channel(p, "seen", "dem", "t").withColumn("t", F.col("t") / 2)
    return samples.denormalize(half, normalize.dem_scale(p, "seen"), "t", "back").select(*KEY, _r("back"))


@query
def channel_stack(spark, sf_dir):
    p = embedding_patches(spark, sf_dir).withColumn("coarse", F.col("z") * 2).withColumn("partial", F.when(~F.col("mask"), F.col("z")))
    p = samples.channel_stack(p, ["partial", "coarse", "mask", "slope"], absent="zero")
    return p.select(*KEY, *[_r(f"c{i}", F.get("channels", F.lit(i))) for i in range(4)])


@query
def padded_windows(spark, sf_dir):
    """Windows wider than the raster: what they have beyond it is missing."""
    w = samples.padded_windows(_cells(spark, sf_dir), _grids(spark, sf_dir), 72, 40)
    return w.groupBy("tile", "top", "left").agg(F.count("*").alias("places"), F.count("all_density").alias("cells"), _r("dsm", F.sum("dsm"), 3), F.max("row").alias("last"))


@query
def sample_meta(spark, sf_dir):
    w = windows.window_starts(_grids(spark, sf_dir), 32, 24)
    return samples.with_meta(w, resolution=F.lit(1.5)).select("sample_id", "meta")


@query
def first_samples(spark, sf_dir):
    """The first three samples of all in the order of their ids; a limit is the feature."""
    return windows.sample_ids(windows.window_starts(_grids(spark, sf_dir), 32, 24)).orderBy("sample_id").limit(3).select("sample_id")


@query
def best_epoch(spark, sf_dir):
    """Months as epochs with the mean price as their metric."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    history = o.groupBy(month.cast("int").alias("epoch")).agg(F.round(F.avg("o_totalprice"), 2).alias("loss"))
    return metrics.best_epoch(history, "loss").select("epoch", "loss", "best_before", "improved")


@query
def split_samples(spark, sf_dir):
    """Samples written by split; one split read back."""
    path = f"{components.shared_dir(spark)}/samples-{uuid.uuid4().hex}"
    blocks = normalize.to_blocks(embedding_patches(spark, sf_dir), ["z"])
    tables.write_samples(blocks.withColumn("split", F.when(F.col("tile") % 10 == 0, "val").otherwise("train")), path)
    return normalize.from_blocks(tables.read_samples(spark, path, "val"), ["z"], 8).select(*KEY, _r("z"))


@query
def tile_summary(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("support", F.col("all_density") > 0).withColumn("reference", F.col("dem"))
    c = c.withColumn("low_confidence", F.col("dem").isNotNull() & (F.col("ground_density") < 2)).withColumn("tiny_hole", F.col("support") & F.col("dem").isNull())
    return grid.tile_summary(lineitem_points(spark, sf_dir), c)


@query
def predict_tiles(spark, sf_dir):
    """Void cells as the coarse surface plus a sixteenth of its slope, in windows of 32 cells."""
    c = _cells(spark, sf_dir).select(*KEY, F.col("dem").alias("z"))
    predictor = F.col("coarse") + F.col("slope") * 0.0625
    done = samples.predict_tiles(c, _grids(spark, sf_dir), predictor, size=32, stride=24, method="nearest", radii=(3,))
    return done.select(*KEY, _r("predicted"), "covers")


@query
def raster_build(spark, sf_dir):
    """Points to all bands in one plan, with the repaired mean elevation."""
    c = composites.raster_build(lineitem_points(spark, sf_dir), "mean")
    same = ["dsm", *composites.DENSITIES, "dem_valid_mask", "dem_support_mask", "dem_lowconf_mask", "dem_tinyhole_mask"]
    rounded = ["dem_raw", "dem_reference", "mean_intensity", "mean_return_num", "last_return_ratio", "ground_penetration_ratio", "dem_repair_weight", "dem_confidence"]
    return c.select(*KEY, *same, *[_r(b) for b in rounded])


@query
def repair_tiles(spark, sf_dir):
    """Cells without ground, whether the surface is there or not, by an expression over normalised channels, in windows of 32 cells."""
    c = _cells(spark, sf_dir).withColumn("z", F.coalesce("dem", "dsm")).withColumn("valid", F.col("dem").isNotNull()).drop("dem")
    predictor = F.col("coarse_n") + F.col("c.slope") * 0.0625 + F.col("c.confidence_map") * 0.125 - F.col("c.ground_density") * 0.25
    return composites.repair_tiles(c, _grids(spark, sf_dir), predictor, size=32, stride=24).select(*KEY, _r("predicted"), "covers")


# without SQL: tested against brute force


@query
def build_samples(spark, sf_dir):
    """Samples of 32 cells with simulated voids: one row each, with sums over its cells."""
    c = _cells(spark, sf_dir).withColumn("dem", F.coalesce("dem", "dsm")).drop("dem_valid_mask")
    cells, kept = composites.build_samples(c, _grids(spark, sf_dir), 32, 16, least_valid=0.8)
    sums = [F.sum(c).alias(c) for c in ("gt", "partial", "coarse", "confidence_map", "slope")]
    per = cells.groupBy("sample_id").agg(F.count("*").alias("n"), F.count_if("mask").alias("masked"), *sums)
    return per.join(kept, "sample_id").select("sample_id", "strategy", "meta", "n", "masked", _r("mask_ratio"), *[_r(c, digits=3) for c in ("gt", "partial", "coarse", "confidence_map", "slope")])


@query
def tin_surface(spark, sf_dir):
    c, g = _cells(spark, sf_dir), _grids(spark, sf_dir)
    p = lineitem_points(spark, sf_dir).where("cls = 2")
    done = samples.tin_surface(p, g, c)
    return done.select(*KEY, _r("tin"), _r("reference"), "valid", "support", "confidence", "repair_weight")


@query
def tin_dem(spark, sf_dir):
    p = lineitem_points(spark, sf_dir).where("cls = 2")
    return tin.tin(p, _grids(spark, sf_dir)).select(*KEY, _r("z"))


@query
def repair_regression(spark, sf_dir):
    p = stencil.slope(embedding_patches(spark, sf_dir)).withColumn("gt", F.col("z"))
    p = nearest.nearest_fill(p.withColumn("partial", F.when(~F.col("mask"), F.col("z"))), "partial", "coarse")
    model = repair.fit_residual(p, ["coarse", "slope"])
    r = repair.residual(model, ["coarse", "slope"])
    return repair.repair(p, [r, r * 0.5]).select(*KEY, _r("stage1"), _r("stage2"), "mask")


@query
def train_epochs(spark, sf_dir):
    """Six epochs over the patches with simulated voids, every tenth held out: one row per epoch. Every second state is saved."""
    p = embedding_patches(spark, sf_dir).withColumn("gt", F.col("z")).withColumn("partial", F.when(~F.col("mask"), F.col("z")))
    p = stencil.slope(nearest.nearest_fill(p, "partial", "coarse"), "coarse")
    p = composites.normalized_channels(p, ["coarse_dem", "slope"], z="partial")
    normal = (F.col("gt") - F.col("mean")) / F.col("std")
    p = p.select(*KEY, normal.alias("gt"), F.col("coarse_n").alias("coarse"), "mask", "std", "c.coarse_dem", "c.slope")
    how = training.Training(epochs=6, learning_rate=0.05, save_every=2)
    path = f"{components.shared_dir(spark)}/training-{uuid.uuid4().hex}"
    held = F.col("tile") % 10 == 0
    done = training.train(p.where(~held), p.where(held), path, ["coarse_dem", "slope"], how, scale=F.col("std"))
    return done.select("epoch", *[_r(c) for c in ("train_loss", "lr", "mask_rmse", "best_before")], "improved")


@query
def las_headers(spark, sf_dir):
    """The points written as LAS files and the headers read back, without reading points; coordinates in 64ths stay exact."""
    path = f"{components.shared_dir(spark)}/las-{uuid.uuid4().hex}"
    heads = las.write_las(lineitem_points(spark, sf_dir), path, file_points=20_000, scale=1 / 64)
    ends = [F.min(f"min_{c}").alias(f"min_{c}") for c in "xyz"] + [F.max(f"max_{c}").alias(f"max_{c}") for c in "xyz"]
    return heads.groupBy("tile").agg(F.sum("point_count").alias("point_count"), *ends)


@query
def las_round_trip(spark, sf_dir):
    """The points written as LAS files and read back in ranges of records."""
    path = f"{components.shared_dir(spark)}/las-{uuid.uuid4().hex}"
    las.write_las(lineitem_points(spark, sf_dir), path, file_points=20_000, scale=1 / 64)
    read = spark.read.format("las").option("chunk_size", 5000).load(path)
    sums = [F.sum(c).cast("long" if c not in "xyz" else "double").alias(f"sum_{c}") for c in ("x", "y", "z", "intensity", "return_num", "num_returns")]
    return read.groupBy("tile", "cls").agg(F.count("*").alias("n"), *sums)


@query
def raster_round_trip(spark, sf_dir):
    """Bands of the cells written as raster files and read back in ranges of strips."""
    path = f"{components.shared_dir(spark)}/rasters-{uuid.uuid4().hex}"
    bands = ["dsm", "all_density", "mean_return_num"]
    raster.write_rasters(_cells(spark, sf_dir), _grids(spark, sf_dir), path, bands, strip="16")
    read = [raster.read_rasters(spark, path, b, blocks="2").select("tile", F.lit(b).alias("band"), "row", "col", _r("v", digits=3)) for b in bands]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query
def raster_headers(spark, sf_dir):
    path = f"{components.shared_dir(spark)}/rasters-{uuid.uuid4().hex}"
    raster.write_rasters(_cells(spark, sf_dir), _grids(spark, sf_dir), path, ["dsm"])
    return raster.read_rasters(spark, path, "dsm", headers=True).select("tile", "height", "width", "resolution", "west", "north", "nodata", "dtype")


@query
def stream_las_cells(spark, sf_dir):
    """LAS files that arrive in two rounds; between these the stream is stopped and starts again where it was."""
    path = f"{components.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    points, grids = lineitem_points(spark, sf_dir).where("cls in (2, 5, 6)"), _grids(spark, sf_dir)
    for part in ("intensity < 30000", "intensity >= 30000"):
        las.write_las(points.where(part), f"{path}/las", file_points=20_000, scale=1 / 64)
        arriving = stream.las_stream(spark, f"{path}/las", chunk_size="5000", records_per_batch="30000")
        stream.stream_cells(arriving, grids, f"{path}/partials", f"{path}/checkpoint").awaitTermination()
    done = stream.merged_cells(spark.read.parquet(f"{path}/partials"))
    return done.select(*KEY, "n", "n_ground", _r("dem"), "dsm")


@query
def stream_cell_stats(spark, sf_dir):
    """The points as a stream of files; the windowed return count isn't needed for these bands."""
    static = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    table = spark.readStream.schema(static.schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    k, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    x = ((k * 7 + p * 3 + n * 11) % 64).cast("double") + (F.floor("l_quantity").cast("bigint") % 64).cast("double") / 64
    y = ((k * 5 + s * 13 + n * 17) % 64).cast("double") + (F.round(F.col("l_extendedprice") * 100).cast("bigint") % 64).cast("double") / 64
    cls = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (n <= 2), 2).when(F.col("l_returnflag") == "N", 5).when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), 6).otherwise(1)
    points = table.select(F.when(k % 2 == 0, "001").otherwise("002").alias("tile"), x.alias("x"), y.alias("y"), ((F.floor("l_extendedprice").cast("bigint") % 16384).cast("double") / 64).alias("z"), cls.alias("cls"))
    surface = points.where(F.col("cls").isin(2, 5, 6)).where(~((F.col("cls") == 2) & ((F.col("x") - 20) * (F.col("x") - 20) + (F.col("y") - 44) * (F.col("y") - 44) < 81)))
    path = f"{components.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    done = stream.stream_and_merge(surface, _grids(spark, sf_dir), path)
    return done.select(*KEY, "n", "n_ground", _r("dem"), "dsm")
