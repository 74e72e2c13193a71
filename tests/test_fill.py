"""Filling of voids wider than a few cells, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.operators import components, fill, lines, nearest, stencil

from .test_operators import cells, grid_of


def void(shape, centre, radius, step=1):
    """Values on every step-th row and column but in a disk."""
    r, c = np.indices(shape)
    z = np.random.default_rng(7).random(shape) * 9 + 1
    return np.where(((r - centre[0]) ** 2 + (c - centre[1]) ** 2 <= radius**2) | (r % step > 0) | (c % step > 0), np.nan, z)


def frame(spark, z):
    return cells(spark, [[None if np.isnan(v) else float(v) for v in line] for line in z])


def brute(z, radius, smoothing=0):
    valid, out = np.argwhere(~np.isnan(z)), z.copy()
    for p in np.argwhere(np.isnan(z)):
        d2 = ((valid - p) ** 2).sum(1)
        k = np.where(d2 <= radius**2, 1 / d2, 0.0)
        if k.sum():
            out[tuple(p)] = (k * z[tuple(valid.T)]).sum() / k.sum()
    return smoothed(z, out, smoothing)


def smoothed(z, out, passes):
    for _ in range(passes):
        before = out.copy()
        for r, c in np.argwhere(np.isnan(z) & ~np.isnan(before)):
            out[r, c] = np.nanmean(before[max(r - 1, 0) : r + 2, max(c - 1, 0) : c + 2])
    return np.nan_to_num(out)


def quarters(z, distance, smoothing=0):
    """The nearest valid cell of each closed quarter, by looking at all of them."""
    valid, out = np.argwhere(~np.isnan(z)), z.copy()
    for p in np.argwhere(np.isnan(z)):
        weights = values = 0.0
        for up in (1, -1):
            for left in (1, -1):
                d = p - valid
                own = valid[(d[:, 0] * up >= 0) & (d[:, 1] * left >= 0) & ((d * d).sum(1) <= distance * distance)]
                if len(own):
                    far = ((own - p) ** 2).sum(1)
                    k = min(range(len(own)), key=lambda i: (far[i], abs(own[i][1] - p[1])))
                    weights += 1 / np.sqrt(far[k])
                    values += z[tuple(own[k])] / np.sqrt(far[k])
        if weights:
            out[tuple(p)] = values / weights
    return smoothed(z, out, smoothing)


def test_wide_void_is_filled_to_its_middle(spark):
    z = void((70, 61), (30, 30), 28)
    got = grid_of(nearest.inverse_distance(frame(spark, z), "z"), "idw", z.shape)
    assert got[30, 30] >= 1 and np.allclose(got, brute(z, 64))
    got = grid_of(fill.interpolate(frame(spark, z), "z", smoothing=1), "filled", z.shape)
    assert got[30, 30] >= 1 and np.allclose(got, quarters(z, 64, 1))


@pytest.mark.parametrize("distance,smoothing,step", [(64, 0, 5), (4, 1, 3), (2.5, 2, 4), (1, 0, 3)])
def test_search_fill_by_brute_force(spark, distance, smoothing, step):
    z = void((41, 37), (20, 18), 14, step)
    got = nearest.search_fill(frame(spark, z), "z", distance, smoothing)
    assert np.allclose(grid_of(got, "idw", z.shape), quarters(z, distance, smoothing))


def test_search_fill_keeps_tiles_apart(spark):
    """Tiles of many widths in one task, one of them without any value, and columns that pass through."""
    shapes = [(3, 5), (9, 2), (1, 30), (12, 12), (4, 1)]
    rows, want = [], {}
    for t, shape in enumerate(shapes):
        z = np.full(shape, np.nan) if t == 3 else void(shape, (1, 1), 1, 2)
        want[t] = quarters(z, 9)
        rows += [(t, r, c, None if np.isnan(v) else float(v), f"{t}-{r}") for (r, c), v in np.ndenumerate(z)]
    got = nearest.search_fill(spark.createDataFrame(rows, "tile long, row int, col int, z double, name string"), "z", 9).toPandas()
    assert len(got) == len(rows) and (got["name"] == got["tile"].astype(str) + "-" + got["row"].astype(str)).all()
    for r in got.itertuples():
        assert abs(r.idw - want[r.tile][r.row, r.col]) < 1e-9


def test_nearest_takes_ties_by_row_then_column(spark):
    rng = np.random.default_rng(2)
    z = np.where(rng.random((30, 41)) < 0.03, rng.integers(1, 900, (30, 41)), np.nan)
    got = nearest.nearest_valid(frame(spark, z), "z").toPandas().set_index(["row", "col"])
    valid = [tuple(p) for p in np.argwhere(~np.isnan(z))]
    for r, c in np.ndindex(z.shape):
        d2, vr, vc = min(((a - r) ** 2 + (b - c) ** 2, a, b) for a, b in valid)
        assert got.loc[(r, c), "near"] == z[vr, vc] and abs(got.loc[(r, c), "distance"] - d2**0.5) < 1e-9


@pytest.mark.parametrize("one_sided", [False, True])
def test_envelope_against_all_columns(one_sided):
    rng = np.random.default_rng(4)
    for _ in range(120):
        h = rng.integers(0, rng.choice([3, 30, 400]), rng.integers(1, (6, 30)))
        h[rng.random(h.shape) < rng.choice([0.1, 0.6, 0.95])] = -1
        got = lines.envelope(h, one_sided=one_sided)
        for (b, x), c in np.ndenumerate(got):
            all_of = [((x - k) ** 2 + h[b, k], -k if one_sided else k, k) for k in range(h.shape[1]) if h[b, k] >= 0 and (not one_sided or k <= x)]
            assert c == (min(all_of)[2] if all_of else -1)


def test_wide_holes_take_linear_work(monkeypatch):
    """Each column of a hole of 2,000 cells is put on the stack once and taken off once at the most."""
    looked = []
    keep = np.flatnonzero
    monkeypatch.setattr(lines.np, "flatnonzero", lambda x: looked.append(len(r := keep(x))) or r)
    h = np.concatenate([[0], np.arange(1000, 3000) ** 2, [0]])
    for height in (h, h[::-1], np.where(np.arange(len(h)) % 3, h, -1)):
        looked.clear()
        lines.envelope(height[None].copy(), one_sided=False)
        assert sum(looked) <= len(h)
    assert set(lines.envelope(h[None])[0]) == {0, len(h) - 1}


def holes_by_rule(z, domain, area, least):
    """Areas of all missing cells by flood fill; only then the domain counts."""
    ok, seen, out = ~np.isnan(z), np.zeros(z.shape, bool), np.zeros(z.shape, bool)
    for start in zip(*np.nonzero(~ok), strict=True):
        if seen[start]:
            continue
        part, seen[start] = [start], True
        for r, c in part:
            for p in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if 0 <= p[0] < z.shape[0] and 0 <= p[1] < z.shape[1] and not ok[p] and not seen[p]:
                    seen[p] = True
                    part.append(p)
        most = max(ok[max(r - 1, 0) : r + 2, max(c - 1, 0) : c + 2].sum() for r, c in part)
        if len(part) <= area and most >= least:
            for p in part:
                out[p] = True
    return out & domain


def test_rim_of_a_large_void_is_no_tiny_hole(spark):
    z = void((24, 24), (12, 11), 7)
    rng = np.random.default_rng(3)
    z[rng.random(z.shape) < 0.12] = np.nan
    r, c = np.indices(z.shape)
    domain = (r - 12) ** 2 + (c - 11) ** 2 > 36
    rows = [("t", i, j, None if np.isnan(v) else float(v), bool(domain[i, j])) for (i, j), v in np.ndenumerate(z)]
    got = fill.tiny_holes(spark.createDataFrame(rows, "tile string, row int, col int, z double, domain boolean"), "z", "domain")
    want = holes_by_rule(z, domain, 8, 5)
    assert (grid_of(got, "tiny_hole", z.shape).astype(bool) == want).all() and want.any() and (np.isnan(z) & domain & ~want).any()


@pytest.mark.parametrize("radius,smoothing", [(2, 0), (9, 1), (12, 2)])
def test_inverse_distance_by_brute_force(spark, radius, smoothing):
    z = void((41, 37), (20, 18), 14, step=3)
    assert np.allclose(grid_of(nearest.inverse_distance(frame(spark, z), "z", radius, smoothing), "idw", z.shape), brute(z, radius, smoothing))


def reference_input(spark, z):
    c = frame(spark, z).withColumnRenamed("z", "dem").withColumn("all_density", F.lit(6.0))
    return c.withColumn("ground_density", F.when(F.col("dem").isNotNull(), 6.0).otherwise(0.0)).withColumn("ground_penetration_ratio", F.col("ground_density") / 6)


def test_reference_dem_takes_the_weighted_surface(spark):
    z = void((31, 31), (15, 15), 11)
    done = fill.reference_dem(reference_input(spark, z), support=F.col("all_density") > 0).toPandas()
    got = done.pivot(index="row", columns="col", values="reference").to_numpy()
    surface = quarters(z, 48, 1)
    near = np.pad(surface, 1, mode="edge")
    median = np.median([near[i : i + 31, j : j + 31] for i in range(3) for j in range(3)], axis=0)
    assert done["filled"].sum() == np.isnan(z).sum() and done["support"].all() and done["valid"].sum() == (~np.isnan(z)).sum()
    assert np.allclose(got, np.where(np.isnan(z), 0.25 * surface + 0.75 * median, z))


def test_reference_dem_without_penetration_and_support(spark):
    """Support is what is seen, with a step around it; nothing fills holes or draws spikes; no penetration counts as full."""
    z = void((15, 15), (7, 7), 4)
    how = fill.Repair(method="nearest", support_dilation=1, gap_area=0, median_size=1, hole_area=0, max_distance=0)
    done = fill.reference_dem(reference_input(spark, z), ratio=None, how=how).toPandas().set_index(["row", "col"])
    ok = ~np.isnan(z)
    wide = ok.copy()
    for r, c in np.argwhere(ok):
        for p in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= min(p) and max(p) < 15:
                wide[p] = True
    for (r, c), row in done.iterrows():
        assert row["support"] == wide[r, c] and row["filled"] == (wide[r, c] and not ok[r, c])
        assert np.isnan(row["reference"]) != wide[r, c] and row["confidence"] == (1.0 if ok[r, c] else 0.3 if wide[r, c] else 0.0)


def test_cells_not_observed_are_no_sources(spark):
    z = void((9, 9), (4, 4), 1)
    c = reference_input(spark, z).withColumn("seen", F.col("row") > 2)
    done = fill.reference_dem(c, observed=F.col("seen"), support=F.lit(True)).toPandas()
    assert (done["valid"] == ((done["row"] > 2) & done["dem"].notna())).all() and done["reference"].notna().all()
    assert done.loc[done["row"] <= 2, "filled"].all()


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_labels_of_any_block_size(spark, monkeypatch, bits):
    """Snakes over many blocks and two tiles of other sizes; a block of 256 cells needs no graph."""
    monkeypatch.setattr(components, "BLOCK_BITS", bits)
    rng = np.random.default_rng(6)
    snake = np.zeros((13, 11), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    rows, flags = [], {"a": snake, "b": rng.random((17, 6)) < 0.6, "c": np.zeros((3, 3), bool)}
    for t, f in flags.items():
        rows += [(t, r, c, bool(x) if (r + c) % 7 or x else None) for (r, c), x in np.ndenumerate(f)]
    got = components.label_components(spark.createDataFrame(rows, "tile string, row int, col int, hole boolean"), "hole").toPandas()
    assert len(got) == len(rows)
    for t, f in flags.items():
        own = {(r.row, r.col): r.label for r in got[got["tile"] == t].itertuples()}
        label = {}
        for p in zip(*np.nonzero(f), strict=True):
            if p not in label:
                stack, label[p] = [p], p
                for r, c in stack:
                    for q in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                        if 0 <= q[0] < f.shape[0] and 0 <= q[1] < f.shape[1] and f[q] and q not in label:
                            label[q] = p
                            stack.append(q)
        for p, v in own.items():
            assert (v == v) == (p in label) and (p not in label or v == (int(label[p][0]) << 32) + int(label[p][1]))


def test_median_leaves_gaps_out(spark):
    rng = np.random.default_rng(8)
    z = np.where(rng.random((9, 7)) < 0.4, np.nan, rng.integers(0, 50, (9, 7)).astype(float))
    z[:3, :3] = np.nan
    for size in (1, 3, 4, 5):
        got = stencil.median(frame(spark, z), "z", size).toPandas().set_index(["row", "col"])["median"]
        for r, c in np.ndindex(z.shape):
            at = [(min(max(r + i, 0), 8), min(max(c + j, 0), 6)) for i in range(-(size // 2), size - size // 2) for j in range(-(size // 2), size - size // 2)]
            v = sorted(z[p] for p in at if not np.isnan(z[p]))
            assert np.isnan(got[r, c]) if not v else got[r, c] == v[len(v) // 2]
