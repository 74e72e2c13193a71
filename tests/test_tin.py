"""The triangulation by blocks and rounds against one triangulation of all points."""

import numpy as np
import pytest

from terrasift.operators import grid, tin


def heights(xy, z, west, north, height, width, max_edge):
    """By one triangulation: the height at each cell centre, and whether it is far enough from an edge to tell."""
    t = tin.delaunay(xy)
    out, clear = np.full((height, width), np.nan), np.ones((height, width), bool)
    if not len(t):
        return out, clear
    a, b, c = (xy[t[:, k]] for k in range(3))
    longest = np.sqrt(np.stack([((a - b) ** 2).sum(1), ((b - c) ** 2).sum(1), ((c - a) ** 2).sum(1)])).max(0)
    area = tin._cross(b - a, c - a)
    for r, k in np.ndindex(height, width):
        at = np.array([west + k, north - r]) - a
        u, v = tin._cross(at, c - a) / area, tin._cross(b - a, at) / area
        least = np.minimum(np.minimum(u, v), 1 - u - v)
        i = int(least.argmax())
        clear[r, k] = abs(least[i]) > 1e-6
        if least[i] > 0 and (max_edge <= 0 or longest[i] <= max_edge):
            out[r, k] = z[t[i, 0]] + u[i] * (z[t[i, 1]] - z[t[i, 0]]) + v[i] * (z[t[i, 2]] - z[t[i, 0]])
    return out, clear


def compare(spark, clouds, max_edge, most):
    rows = [(t, float(x), float(y), float(h)) for t, (xy, z) in clouds.items() for (x, y), h in zip(xy, z, strict=True)]
    p = spark.createDataFrame(rows, "tile string, x double, y double, z double")
    specs = grid.grid_specs(grid.tile_headers(p))
    got = tin.tin(p, specs, max_edge=max_edge, most_points=most).collect()
    assert len({(r.tile, r.row, r.col) for r in got}) == len(got)
    for g in specs.collect():
        want, clear = heights(*clouds[g.tile], g.center_min_x, g.center_max_y, g.height, g.width, max_edge)
        have = np.full(want.shape, np.nan)
        for r in got:
            if r.tile == g.tile:
                have[r.row, r.col] = r.z
        assert np.allclose(have[clear], want[clear], atol=1e-6, equal_nan=True), (g.tile, np.argwhere(clear & ~np.isclose(have, want, equal_nan=True))[:5])
    return len(got)


def clouds(seed):
    """A ring around a void, a dense spot in thin points, a thin strip, two far groups, three points, a line, two points."""
    rng = np.random.default_rng(seed)
    even = rng.uniform(0, 60, (500, 2))
    made = {
        "void": even[((even - 30) ** 2).sum(1) > 15**2],
        "spot": np.vstack([rng.uniform(0, 50, (60, 2)), rng.normal(20, 0.8, (300, 2))]),
        "strip": np.column_stack([rng.uniform(0, 90, 80), rng.uniform(0, 2.5, 80)]),
        "far": np.vstack([rng.uniform(0, 8, (40, 2)), rng.uniform(70, 76, (40, 2))]),
        "three": np.array([[0.2, 0.1], [30.3, 2.2], [11.7, 40.9]]),
        "line": np.column_stack([np.arange(30.0), np.arange(30.0) / 2]),
        "two": np.array([[0.0, 0.0], [9.0, 9.0]]),
    }
    return {t: (xy, rng.uniform(0, 9, len(xy))) for t, xy in made.items()}


@pytest.mark.parametrize("max_edge,most", [(0.0, 40), (6.0, 40), (20.0, 2048)])
def test_heights_equal_one_triangulation(spark, max_edge, most):
    assert compare(spark, clouds(1), max_edge, most) > 2000


def test_one_cell_with_more_points_than_a_block_takes(spark):
    rng = np.random.default_rng(5)
    xy = np.vstack([rng.uniform(0, 5, (30, 2)), 2 + rng.normal(0, 0.05, (400, 2))])
    assert compare(spark, {"a": (xy, rng.uniform(0, 9, len(xy)))}, 0.0, 32) > 10


def test_blocks_cover_each_cell_once_and_are_bounded(spark):
    rng = np.random.default_rng(7)
    xy = np.vstack([rng.uniform(0, 150, (400, 2)), rng.normal(40, 3, (900, 2))])
    p = spark.createDataFrame([("a", float(x), float(y), 0.0) for x, y in xy], "tile string, x double, y double, z double")
    g = grid.grid_specs(grid.tile_headers(p))
    w = g.first()
    row, col = np.floor(w.center_max_y + 0.5 - xy[:, 1]).astype(int), np.floor(xy[:, 0] - w.center_min_x + 0.5).astype(int)
    cells, n = np.unique(np.column_stack([row, col]), axis=0, return_counts=True)
    places = spark.createDataFrame([("a", int(r), int(c), int(k)) for (r, c), k in zip(cells, n, strict=True)], "tile string, row int, col int, n long")
    leaves = tin._leaves(places, g, 100).collect()
    covered = np.zeros((w.height, w.width), int)
    for x in leaves:
        covered[x.br * x.side : (x.br + 1) * x.side, x.bc * x.side : (x.bc + 1) * x.side] += 1
        halo = max(x.side // 4, 1)
        inside = (row >= x.br * x.side - halo) & (row < (x.br + 1) * x.side + halo) & (col >= x.bc * x.side - halo) & (col < (x.bc + 1) * x.side + halo)
        assert x.n == inside.sum() and (x.n <= 100 or x.side == 1)
    assert (covered == 1).all() and len({x.side for x in leaves}) > 3


def test_dense_blocks_take_points_by_their_cells(spark):
    """Blocks of few cells don't triangulate all the points that a block may have, and take the nearest ones (F3, F6)."""
    rng = np.random.default_rng(3)
    xy = np.vstack([rng.uniform(0, 4, (3600, 2)), [[1.0, 1.0]] * 3, 2.5 + rng.normal(0, 1e-5, (90, 2))])
    p = spark.createDataFrame([("a", float(x), float(y), 0.0) for x, y in xy], "tile string, x double, y double, z double")
    places = p.selectExpr("tile", "cast(floor(4.5 - y) as int) as row", "cast(floor(x + 0.5) as int) as col").groupBy("tile", "row", "col").count().withColumnRenamed("count", "n")
    g = grid.grid_specs(grid.tile_headers(p))
    assert all(r.side == 1 or r.n <= 64 * r.side**2 for r in tin._leaves(places, g, tin.MOST_POINTS).collect())
    blocks = spark.createDataFrame([("a", 1, r, c) for r in range(5) for c in range(5)], "tile string, side int, br int, bc int")
    dealt = p.crossJoin(blocks.drop("tile")).selectExpr("*", "0D as _west", "4D as _north")
    got = {}
    for r in tin._nearest(dealt, 64, 1.0).collect():
        got.setdefault((r.br, r.bc), []).append((r.x, r.y))
    assert len(got) == 25
    for (r, c), near in got.items():
        d = lambda v: ((np.asarray(v) - [c, 4 - r]) ** 2).sum(1)  # noqa: B023, E731
        assert np.allclose(np.sort(d(near)), np.sort(d(xy))[:64], atol=0)
    made = np.unique(xy, axis=0)
    assert compare(spark, {"a": (made, rng.uniform(0, 9, len(made)))}, 0.0, 2048) == 9


def test_empty(spark):
    p = spark.createDataFrame([], "tile string, x double, y double, z double")
    assert tin.tin(p, grid.grid_specs(grid.tile_headers(p))).count() == 0
