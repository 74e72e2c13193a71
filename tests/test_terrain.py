"""The terrain stack: its input, and the windows of all four radii."""

import numpy as np

from terrasift.operators import stencil
from terrasift.plans.queries import QUERIES
from terrasift.sources.views import synthetic_surface

from .test_operators import grid_of

RADII = (3, 7, 15, 31)


def openness(z, r):
    n = range(z.shape[0]), range(z.shape[1])
    box = lambda i, j: z[max(i - r, 0) : i + r + 1, max(j - r, 0) : j + r + 1]
    return np.array([[z[i, j] - (box(i, j).max() + box(i, j).min()) / 2 for j in n[1]] for i in n[0]])


def test_openness_of_the_analytic_surface(spark):
    c = synthetic_surface(spark, 72)
    z = grid_of(c, "z", (72, 72))
    got = stencil.openness(c, radii=RADII).toPandas()
    for i, r in enumerate(RADII, 1):
        assert np.allclose(got.pivot(index="row", columns="col", values=f"openness_s{i}").to_numpy(), openness(z, r))


def test_terrain_stack_covers_the_cells_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    got, cells = QUERIES["terrain_stack"](spark, sf).toPandas(), QUERIES["nearest_fill"](spark, sf).toPandas()
    assert len(got) == len(cells) and set(got["tile"]) == set(cells["tile"])
    for tile, part in got.groupby("tile"):
        z = part.pivot(index="row", columns="col", values="z").to_numpy()
        for i, r in enumerate(RADII, 1):
            assert np.allclose(part.pivot(index="row", columns="col", values=f"openness_s{i}").to_numpy(), openness(z, r), atol=1e-5)
