"""Tile joins, samples and prediction by windows on small tables."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.functions.columns import poisson
from terrasift.operators import grid, quality, samples, tiles, tin, voids
from terrasift.plans.queries import QUERIES
from terrasift.sources import tables
from terrasift.sources.views import synthetic_surface

SF = "/root/testdata/sf0.001"


def cells(spark, z, tile="a"):
    return spark.createDataFrame([(tile, r, c, None if v is None else float(v)) for r, line in enumerate(z) for c, v in enumerate(line)], "tile string, row int, col int, z double")


def grids(spark, height, width):
    return spark.createDataFrame([("a", height, width)], "tile string, height int, width int")


def test_points_are_not_shuffled_by_tile(spark):
    """With a planner that broadcasts nothing by itself, the one row per tile still is, and points go straight to their cells."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["rasterize_mean"](spark, SF)._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("SortMergeJoin")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan
    assert not re.search(r"hashpartitioning\(tile#\d+, \d+\)", plan)


def test_many_tiles_are_salted(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BROADCAST_TILES", 3)
    df = spark.range(500).select((F.col("id") % 10).cast("string").alias("tile"), "id")
    one = spark.range(10).select(F.col("id").cast("string").alias("tile"), (F.col("id") * 2).alias("x"))
    got = tiles.with_tiles(df, one)
    assert got.columns == ["tile", "id", "x"]
    assert sorted(map(tuple, got.collect())) == sorted((str(i % 10), i, i % 10 * 2) for i in range(500))


def test_matched_tiles_name_what_is_missing(spark):
    one, two = (spark.createDataFrame([(t, 1) for t in x], f"tile string, {n} int") for x, n in (("ab", "x"), ("abc", "y")))
    assert samples.matched_tiles(one, two.where("tile <> 'c'")).count() == 2
    with pytest.raises(Exception, match="for tile c"):
        samples.matched_tiles(one, two).collect()
    got = spark.createDataFrame([("t1_dem",), ("dem_t",)], "n string").select(samples.stem(F.col("n"), "_dem").alias("s")).collect()
    assert [r.s for r in got] == ["t1", "dem_t"]


def test_tile_sources_without_optional_bands(spark):
    c = cells(spark, [[1, None], [3, 4]]).withColumnRenamed("z", "dem")
    assert [(r.z, r.valid) for r in samples.tile_sources(c).orderBy("row", "col").collect()] == [(1.0, True), (None, False), (3.0, True), (4.0, True)]
    c = c.withColumn("ground_density", F.col("row").cast("double"))
    assert [r.valid for r in samples.tile_sources(c).orderBy("row", "col").collect()] == [False, False, True, True]


def test_features_fill_first(spark):
    z = [[float(r * 3 + c) for c in range(6)] for r in range(6)]
    z[2][3] = None
    got = {(r.row, r.col): r for r in samples.terrain_features(cells(spark, z), "z", radii=(1,)).collect()}
    z[2][3] = z[1][3]  # the nearest valid cell, least row first
    gy, gx = np.gradient(np.array(z))
    slope = np.sqrt(gx**2 + gy**2)
    assert all(r.slope == pytest.approx(slope[k]) and r.openness_s1 is not None for k, r in got.items())
    none = samples.terrain_features(cells(spark, [[None, None]] * 2), "z", radii=(1,)).collect()
    assert {(r.slope, r.curvature, r.openness_s1) for r in none} == {(0.0, 0.0, 0.0)}


def test_padded_windows_and_meta(spark):
    c = cells(spark, [[1, 2, 3]] * 2)
    w = samples.padded_windows(c, grids(spark, 2, 3), 4, 2)
    assert w.count() == 16 and w.where("z is null").count() == 10
    meta = samples.with_meta(w.select("tile", "top", "left").distinct(), split=F.lit("val")).first()
    assert meta.sample_id == "a_r00000_c00000"
    assert json.loads(meta.meta) == {"sample_id": "a_r00000_c00000", "tile_id": "a", "row": 0, "col": 0, "split": "val"}
    kept = samples.kept_by_mask_ratio(c.withColumn("mask", F.col("z") == 2), ["tile"], least=1 / 3, most=0.35)
    assert kept.first().mask_ratio == pytest.approx(1 / 3)
    assert samples.kept_by_mask_ratio(c.withColumn("mask", F.col("z") == 2), ["tile"]).count() == 1
    assert samples.kept_by_mask_ratio(c.withColumn("mask", F.lit(None).cast("boolean")), ["tile"]).count() == 0


def test_channel_stack(spark):
    c = cells(spark, [[1, None]]).withColumn("coarse", F.lit(9.0)).withColumnRenamed("z", "partial")
    assert sorted(r.channels for r in samples.channel_stack(c, ["coarse", "partial", "x"], absent="zero").collect()) == [[9.0, 1.0, 0.0], [9.0, 9.0, 0.0]]
    with pytest.raises(ValueError, match="x"):
        samples.channel_stack(c, ["partial", "x"])


def test_samples_by_split(spark, tmp_path):
    s = spark.createDataFrame([("a", "train", [1.0]), ("b", "val", [2.0])], "sample_id string, split string, z array<double>")
    tables.write_samples(s, str(tmp_path / "s"))
    assert [r.sample_id for r in tables.read_samples(spark, str(tmp_path / "s"), "val").collect()] == ["b"]
    with pytest.raises(ValueError, match="test"):
        tables.read_samples(spark, str(tmp_path / "s"), "test")
    c = cells(spark, [[1, None], [3, 4]])
    tables.write_cells(c, str(tmp_path / "c"), ["z"], nodata=-9999.0)
    assert sorted((r.row, r.col, r.z) for r in tables.read_cells(spark, str(tmp_path / "c"), ["z"]).collect()) == [(0, 0, 1.0), (0, 1, -9999.0), (1, 0, 3.0), (1, 1, 4.0)]
    with pytest.raises(ValueError, match="dsm"):
        tables.read_cells(spark, str(tmp_path / "c"), ["dsm"])


def test_tile_summary_needs_ground(spark):
    p = spark.createDataFrame([("a", 0.5, 0.5, 1.0, 5)], "tile string, x double, y double, z double, cls int")
    c = cells(spark, [[1]]).withColumnRenamed("z", "dem").selectExpr("*", "true as support", "false as low_confidence", "false as tiny_hole", "dem as reference")
    with pytest.raises(Exception, match="no ground points in tile a"):
        grid.tile_summary(p, c).collect()
    assert grid.tile_summary(p.withColumn("cls", F.lit(2)), c).first().unresolved_cells == 0


def test_shape_violations(spark):
    b = samples.band_table(cells(spark, [[1, 2], [3, 4]]).withColumn("w", F.col("z")), ["z", "w"])
    assert quality.shape_violations(b, ["z", "w"]).count() == 0
    assert [tuple(r) for r in quality.shape_violations(b.where("not (band = 'w' and row = 1)"), ["z", "w", "q"]).orderBy("rule").collect()] == [("a", "lacking", "q"), ("a", "shape", "w")]


def test_prediction_keeps_valid_cells(spark):
    """A smooth surface with a hole: valid cells unchanged, the hole within a little of the truth, whole windows skip the model."""
    truth = synthetic_surface(spark, 96).select("tile", "row", "col", "z")
    hole = (F.col("row").between(30, 41)) & (F.col("col").between(30, 41))
    c = truth.withColumn("z", F.when(~hole, F.col("z")))
    g = spark.createDataFrame([("synthetic", 96, 96)], "tile string, height int, width int")
    done = samples.predict_tiles(c, g, F.col("coarse"), size=48, stride=24, radii=(3,)).join(truth, ["tile", "row", "col"])
    assert done.count() == 96 * 96 and done.where(~hole & (F.abs(F.col("predicted") - F.col("z")) > 1e-9)).count() == 0
    worst, n = done.where(hole).agg(F.max(F.abs(F.col("predicted") - F.col("z"))), F.count("predicted")).first()
    assert n == 144 and worst < 3.0


def test_tin_surface_on_a_plane(spark):
    rng = np.random.default_rng(3)
    xy = rng.uniform(0, 20, (300, 2))
    xy = xy[~((abs(xy[:, 0] - 10) < 3) & (abs(xy[:, 1] - 10) < 3))]
    p = spark.createDataFrame([("a", float(x), float(y), float(2 * x - y), 2) for x, y in xy], "tile string, x double, y double, z double, cls int")
    g = grid.grid_specs(grid.tile_headers(p))
    c = grid.rasterize(p, g, "z", "mean").withColumnRenamed("v", "dem").withColumn("all_density", F.when(F.col("dem").isNotNull(), 1.0).otherwise(0.0))
    got = samples.tin_surface(p, g, c, max_edge=4.0, hole_area=2, distance=12).collect()
    assert len(got) == c.count() and all(r.reference is not None for r in got)
    assert {r.confidence for r in got} <= {1.0, 0.7, 0.0} and any(r.tin is None for r in got)
    west, north = g.select("center_min_x", "center_max_y").first()
    for r in got:
        if r.tin is not None:
            assert r.tin == pytest.approx(2 * (west + r.col) - (north - r.row), abs=1e-6)
        assert r.repair_weight == (0.0 if r.tin is not None else 1.0)


def test_tin_on_a_lattice_and_a_line():
    """Four points of each square lie on one circle, and points on a line make no triangle: no overlap, nothing left out."""
    xy = np.array([(x, y) for x in range(7) for y in range(5)], float)
    a, b, c = (xy[tin.delaunay(xy)[:, k]] for k in range(3))
    assert np.abs(tin._cross(b - a, c - a)).sum() / 2 == pytest.approx(6 * 4)
    line = np.column_stack([np.arange(9.0), np.arange(9.0) / 2])
    assert len(tin.delaunay(line)) == 0


def test_poisson_has_a_long_tail(spark):
    u = spark.range(20_000).select(((F.col("id") + 0.5) / 20_000).alias("u"))
    n = [r.n for r in u.select(poisson(F.col("u"), 30.0).alias("n")).collect()]
    assert np.mean(n) == pytest.approx(30.0, abs=0.05) and np.var(n) == pytest.approx(30.0, rel=0.02) and max(n) > 50


def test_voids_reach_their_target(spark):
    """Few valid cells on a wide raster, and small shapes: enough shapes are drawn, centred on valid cells."""
    c = spark.range(60 * 60).select(F.lit("a").alias("tile"), F.floor(F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col"))
    c = c.withColumn("ok", (F.col("row") < 20) & (F.col("col") < 20))
    void = voids.simulate_voids(c, "irregular", coverage=(0.5, 0.5), radius=(1, 2), valid="ok")
    assert void.where("void and not ok").count() == 0
    assert void.where("void").count() >= 200
