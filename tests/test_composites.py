"""Whole jobs: rasters from points, samples from rasters, tiles repaired by windows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.operators import composites, fill, stencil
from terrasift.plans import queries


def raster(spark, z, **more):
    names = list(more)
    rows = [("t", r, c, None if np.isnan(v) else float(v), *(float(more[n][r, c]) for n in names)) for (r, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, "tile string, row int, col int, z double" + "".join(f", {n} double" for n in names))


def hills(n, m):
    r, c = np.indices((n, m))
    return 50 + 4 * np.sin(r / 5) + 3 * np.cos(c / 4)


def test_channels_by_kind_and_order(spark):
    z = hills(6, 5)
    z[2, 2] = np.nan
    c = raster(spark, z, ground_density=np.full((6, 5), 3.0), mean_intensity=np.full((6, 5), 800.0)).withColumn("partial", F.col("z")).withColumn("coarse", F.coalesce("z", F.lit(1.0)))
    c = c.withColumn("mask", F.col("z").isNull()).withColumn("slope", F.when(F.col("row") > 0, 0.5)).withColumn("confidence_map", F.lit(1.7)).withColumn("other", F.lit(None).cast("double"))
    order = ["slope", "partial_dem", "ground_density", "absent", "confidence_map", "mean_intensity", "mask", "coarse_dem", "other"]
    got = composites.normalized_channels(c, order).collect()
    mean, std = np.nanmean(z), np.nanstd(z)
    for r in got:
        gap = r.row == 2 and r.col == 2
        want = [0.5, 0.0 if gap else (z[r.row, r.col] - mean) / std, np.log1p(3.0) / 3.5, 0.0, 1.0, 800 / 40000, float(gap), (1.0 - mean) / std if gap else (z[r.row, r.col] - mean) / std, 0.0]
        assert np.allclose(r.channels, want) and np.allclose(list(r.c), want)


def test_cells_that_are_not_observed_are_predicted(spark):
    """z is there but not observed: predicted all the same; observed cells, and windows of only such, come back unchanged."""
    z = hills(40, 40)
    c = raster(spark, z, dsm=z + 1).withColumn("valid", ~(F.col("row").between(25, 30) & F.col("col").between(25, 30)))
    grids = spark.createDataFrame([("t", 40, 40)], "tile string, height int, width int")
    got = composites.repair_tiles(c, grids, F.col("coarse_n"), size=16, stride=8, method="nearest").collect()
    assert len(got) == 1600
    own = {(r.row, r.col): r for r in got}
    changed = 0
    for (r, k), v in np.ndenumerate(z):
        if 25 <= r <= 30 and 25 <= k <= 30:
            changed += abs(own[r, k].predicted - v) > 1e-6
            assert z.min() - 1 <= own[r, k].predicted <= z.max() + 1
        else:
            assert abs(own[r, k].predicted - v) < 1e-9
    assert changed > 20


def test_predictor_sees_each_window_alone(spark):
    """One window over the whole raster: the result is the plain composition of its operators."""
    z = hills(12, 11)
    valid = np.ones(z.shape, bool)
    valid[4:8, 3:7] = False
    c = raster(spark, z, dsm=z + 2, ground_penetration_ratio=np.full(z.shape, 0.4), v=valid.astype(float)).withColumn("valid", F.col("v") > 0)
    grids = spark.createDataFrame([("t", 12, 11)], "tile string, height int, width int")
    got = composites.repair_tiles(c.drop("v"), grids, F.col("c.coarse_dem") + F.col("c.confidence_map") + F.col("c.openness_s2"), size=16, stride=8)
    part = c.withColumn("mask", ~F.col("valid")).withColumn("partial", F.when(F.col("valid"), F.col("z")))
    part = stencil.openness(fill.interpolate(part, "partial", "idw", radius=64, out="coarse", smoothing=1), "coarse", (3, 7))
    part = fill.confidence_map(part, ratio="ground_penetration_ratio").toPandas().set_index(["row", "col"])
    mean, std = z.mean(), z.std()
    for r in got.collect():
        p = part.loc[(r.row, r.col)]
        want = z[r.row, r.col] if valid[r.row, r.col] else ((p["coarse"] - mean) / std + p["confidence"] + p["openness_s2"]) * std + mean
        assert r.predicted == pytest.approx(want)


def test_raster_build_by_triangles(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x), float(y), float(2 * x - y), 7.0, int(k % 3 and 2 or 5), 1, 1) for k, (x, y) in enumerate(rng.uniform(0, 20, (700, 2)))]
    p = spark.createDataFrame(rows, "tile string, x double, y double, z double, intensity double, cls int, return_num int, num_returns int")
    got = composites.raster_build(p, "tin")
    assert got.columns == ["tile", "row", "col", *composites.BANDS]
    got = got.toPandas()
    assert len(got) == (got["row"].max() + 1) * (got["col"].max() + 1) and got[["dem", "dsm", "dem_reference"]].notna().all().all() and (got["dem_raw"] == got["dem"]).all()
    assert set(got["dem_confidence"]) <= {1.0, 0.7, 0.0} and not got["dem_lowconf_mask"].any() and (got["dem_confidence"] == 1.0).sum() == got["dem_valid_mask"].sum()
    with pytest.raises(ValueError):
        composites.raster_build(p, "splines")


def test_samples(spark):
    z = hills(50, 40)
    z[:, 36:] = np.nan
    c = raster(spark, z, dsm=z + 3, vegetation_density=np.ones(z.shape), ground_penetration_ratio=np.full(z.shape, 0.5)).withColumnRenamed("z", "dem")
    grids = spark.createDataFrame([("t", 50, 40)], "tile string, height int, width int")
    cells, kept = composites.build_samples(c, grids, 24, 16, least_valid=0.9, mask_ratio=(0.03, 0.9), coverage=(0.05, 0.1), resolution=F.lit(1.0))
    kept, cells = kept.toPandas(), cells.toPandas()
    # windows start at 0, 16 and 26 or 16; those flush with the east side miss a sixth of their cells
    assert 0 < len(kept) <= 6 and (kept["left"] == 0).all() and kept["mask_ratio"].between(0.03, 0.9).all()
    assert set(cells["sample_id"]) == set(kept["sample_id"]) and len(cells) == len(kept) * 24 * 24
    for s in kept.itertuples():
        own = cells[cells["sample_id"] == s.sample_id]
        assert own["mask"].mean() == pytest.approx(s.mask_ratio) and own[["gt", "coarse", "dsm", "slope", "confidence_map"]].notna().all().all()
        assert (own["partial"].isna() == own["mask"]).all() and (own.loc[~own["mask"], "coarse"] == own.loc[~own["mask"], "gt"]).all()
        assert (own.loc[~own["mask"], "confidence_map"] == 1.0).all() and (own.loc[own["mask"], "confidence_map"] < 1.0).all()
        meta = json.loads(s.meta)
        assert meta["sample_id"] == s.sample_id and meta["mask_strategy"] == s.strategy and meta["resolution"] == 1.0
        assert np.allclose(own["gt"], [z[s.top + r, s.left + k] for r, k in zip(own["row"], own["col"], strict=True)])


def test_sample_query_gives_rows(spark):
    got = queries.QUERIES["build_samples"](spark, "/root/testdata/sf0.01").collect()
    assert got and all(r.n == 1024 and 0.03 <= r.mask_ratio <= 0.35 and r.masked == round(r.mask_ratio * 1024) for r in got)
