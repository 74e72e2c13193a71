"""Operators that SQL can't express, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.operators import components, fill, nearest, repair, stencil, tin, voids, windows
from terrasift.sources.las import LasSource, las_bytes, read_header, write_las
from terrasift.sources.views import synthetic_surface


def cells(spark, rows):
    return spark.createDataFrame([("t", r, c, z) for r, line in enumerate(rows) for c, z in enumerate(line)], "tile string, row int, col int, z double")


def grid_of(df, band, shape):
    out = np.full(shape, np.nan)
    for x in df.select("row", "col", band).collect():
        out[x[0], x[1]] = np.nan if x[2] is None else x[2]
    return out


def test_gradient_matches_numpy(spark):
    z = np.random.default_rng(0).standard_normal((7, 9))
    s = grid_of(stencil.slope(cells(spark, z.tolist())), "slope", z.shape)
    gy, gx = np.gradient(z)
    assert np.allclose(s, np.hypot(gx, gy))
    k = grid_of(stencil.curvature(cells(spark, z.tolist())), "curvature", z.shape)
    assert np.allclose(k, np.gradient(gx, axis=1) + np.gradient(gy, axis=0))


def test_plane_and_single_cell(spark):
    plane = [[2.0 * c + r for c in range(6)] for r in range(5)]
    assert np.allclose(grid_of(stencil.slope(cells(spark, plane)), "slope", (5, 6)), np.sqrt(5))
    assert grid_of(stencil.slope(cells(spark, [[3.0]])), "slope", (1, 1)) == 0


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(1)
    z = np.where(rng.random((11, 13)) < 0.15, rng.integers(0, 9, (11, 13)), np.nan)
    got = nearest.nearest_valid(cells(spark, [[None if np.isnan(v) else float(v) for v in line] for line in z]), "z")
    valid = np.argwhere(~np.isnan(z))
    for x in got.collect():
        d = ((valid - [x.row, x.col]) ** 2).sum(1)
        best = min(range(len(valid)), key=lambda i: (d[i], *valid[i]))
        assert x.distance == pytest.approx(np.sqrt(d[best])) and x.near == z[tuple(valid[best])]
    none = nearest.nearest_fill(cells(spark, [[None, None]]), "z").collect()
    assert [x.filled for x in none] == [0.0, 0.0]


def test_components_are_4_connected(spark):
    art = ["##.#", ".#.#", "#..#", "###."]
    got = components.label_components(cells(spark, [[float(ch == "#") for ch in line] for line in art]).withColumn("f", F.col("z") > 0), "f")
    label = grid_of(got, "label", (4, 4))
    at = lambda r, c: r * 2**32 + c
    assert label[0, 0] == label[1, 1] == at(0, 0) and label[0, 3] == label[2, 3] == at(0, 3) and label[2, 0] == label[3, 2] == at(2, 0)
    assert np.isnan(label[0, 2])


def test_fill_keeps_valid_cells_and_rejects_methods(spark):
    c = cells(spark, [[1.0, None, 3.0], [None, None, 5.0]])
    for method in ("nearest", "idw", "nearest_gaussian"):
        done = grid_of(fill.interpolate(c, "z", method, sigma=1.0), "filled", (2, 3))
        assert done[0, 0] == 1 and done[1, 2] == 5 and not np.isnan(done).any()
    with pytest.raises(ValueError):
        fill.interpolate(c, "z", "spline")


def test_blend_of_a_constant_is_constant(spark):
    c = cells(spark, [[4.0] * 10] * 7)
    g = spark.createDataFrame([("t", 7, 10)], "tile string, height int, width int")
    b = windows.blend(windows.cut_windows(c, g, 4, 3), "z").collect()
    assert len(b) == 70 and {x.blended for x in b} == {4.0}


def test_voids_stay_within_valid_cells(spark):
    c = synthetic_surface(spark, 48).withColumn("ok", F.col("row") > 8)
    for s in voids.STRATEGIES:
        v = voids.simulate_voids(c, s, valid="ok", weight="col")
        n = v.where("void").count()
        assert n >= 0.05 * 39 * 48 - 1 and v.where("void and not ok").count() == 0
    with pytest.raises(ValueError):
        voids.simulate_voids(c, "spiral")


def test_delaunay_circles_are_empty():
    xy = np.random.default_rng(2).random((60, 2))
    t = tin.delaunay(xy)
    centre, r2 = tin._circles(xy, t)
    d = ((centre[:, None] - xy[None]) ** 2).sum(2)
    assert (d >= r2[:, None] * (1 - 1e-9)).all()
    assert len(tin.delaunay(xy[:2])) == 0


def test_tin_is_exact_on_a_plane_over_blocks(spark):
    rng = np.random.default_rng(3)
    p = [("t", float(x), float(y), float(2 * x - y)) for x, y in rng.random((900, 2)) * 40]
    g = spark.createDataFrame([("t", 0.0, 40.0, 41, 41)], "tile string, center_min_x double, center_max_y double, width int, height int")
    got = tin.tin(spark.createDataFrame(p, "tile string, x double, y double, z double"), g, max_edge=8.0, most_points=200).collect()
    assert len(got) > 1300 and len({(x.row, x.col) for x in got}) == len(got)
    assert max(abs(x.z - (2 * x.col - (40 - x.row))) for x in got) < 1e-6


def test_repair_leaves_other_cells(spark):
    c = synthetic_surface(spark, 32).withColumn("mask", F.col("row").between(8, 16)).withColumn("coarse", F.col("z") - 1).withColumn("gt", F.col("z")).withColumn("one", F.lit(1.0))
    model = repair.fit_residual(c, ["coarse"])
    done = repair.repair(c, [repair.residual(model, ["coarse"])])
    assert done.where("not mask and stage1 != coarse").count() == 0
    assert done.where("mask").agg(F.max(F.abs(F.col("stage1") - F.col("gt")))).first()[0] < 0.01


def test_las_round_trip(spark, tmp_path):
    spark.dataSource.register(LasSource)
    xyz = np.random.default_rng(4).random((5000, 3)) * 100
    (tmp_path / "a.las").write_bytes(las_bytes(xyz, intensity=7, returns=2, returned=3, cls=5))
    assert read_header(str(tmp_path / "a.las"))["count"] == 5000
    got = spark.read.format("las").option("chunk_size", 1200).load(str(tmp_path)).toPandas()
    assert np.allclose(np.sort(got["x"]), np.sort(xyz[:, 0]), atol=6e-4) and set(got["cls"]) == {5} and set(got["num_returns"]) == {3}
    head = spark.read.format("las").option("headers", "true").load(str(tmp_path)).collect()
    assert head[0].tile == "a" and head[0].point_count == 5000
    points = spark.createDataFrame([("t", float(x), float(y), float(z)) for x, y, z in xyz[:50]], "tile string, x double, y double, z double")
    assert sum(r.point_count for r in write_las(points, f"file://{tmp_path}/out").collect()) == 50
    assert spark.read.format("las").load(f"file://{tmp_path}/out").count() == 50


def test_reference_dem_keeps_trusted_cells(spark):
    c = cells(spark, [[float(r + c) if (r * c) % 5 else None for c in range(12)] for r in range(12)]).withColumnRenamed("z", "dem")
    c = c.withColumn("all_density", F.lit(6.0)).withColumn("ground_density", F.when(F.col("dem").isNotNull(), 6.0).otherwise(0.0)).withColumn("ground_penetration_ratio", F.col("ground_density") / 6)
    done = fill.reference_dem(c)
    assert done.count() == 144 and done.where("dem is not null and reference != dem").count() == 0
    assert done.where("filled and reference is null").count() == 0
