"""Training over epochs against a plain loop, and what must hold of reruns, resumed runs and saved states."""

import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.operators import metrics, training
from terrasift.operators.training import Training

SIDE, FEATURES = 9, ["u", "v"]
HOW = Training(epochs=6, learning_rate=0.05, save_every=3, curvature=0.0)


def grids(n, seed=0):
    rng = np.random.default_rng(seed)
    u, v, noise = rng.normal(size=(3, n, SIDE, SIDE))
    mask = rng.random((n, SIDE, SIDE)) < 0.4
    coarse = rng.normal(size=(n, SIDE, SIDE))
    gt = coarse + np.where(mask, 0.7 * u - 0.4 * v + 0.2 + 0.05 * noise, 0.01 * noise)
    return gt, coarse, mask, np.stack([u, v], -1)


def table(spark, data):
    gt, coarse, mask, x = data
    rows = [
        (t, r, c, float(gt[t, r, c]), float(coarse[t, r, c]), bool(mask[t, r, c]), float(x[t, r, c, 0]), float(x[t, r, c, 1]))
        for t in range(len(gt)) for r in range(SIDE) for c in range(SIDE)
    ]
    return spark.createDataFrame(rows, "tile int, row int, col int, gt double, coarse double, mask boolean, u double, v double")


def plain_loss(data, first, second, how):
    """The loss from whole predictions, and its gradient by small differences where it isn't bent."""
    gt, coarse, mask, x = data
    m = mask.astype(float)
    full = np.concatenate([x, np.ones((*mask.shape, 1))], -1)

    def loss(theta):
        one = coarse + m * (full @ theta[:3])
        two = one + m * (full @ theta[3:])
        mean = lambda e, w: (np.abs(e) * w).sum() / max(w.sum(), 1)
        total = how.hole * (mean(two - gt, m) + 0.5 * mean(one - gt, m)) + how.valid * mean(two - gt, 1 - m)
        for axis in (1, 2):
            a, b = (np.take(m, range(k, SIDE - 1 + k), axis) for k in (0, 1))
            total += how.gradient * mean(np.diff(two, axis=axis) - np.diff(gt, axis=axis), np.maximum(a, b))
        return total

    theta = np.r_[first, second]
    g = np.array([(loss(theta + d) - loss(theta - d)) / 2e-7 for d in np.eye(6) * 1e-7])
    return loss(theta), g


def test_gradient_is_that_of_the_loss(spark):
    data = grids(3)
    rng = np.random.default_rng(5)
    first, second = rng.normal(size=(2, 3)) * 0.3
    terms = training.loss_terms(table(spark, data), FEATURES)
    loss, g = training.gradient(terms, first, second, HOW)
    want, slope = plain_loss(data, first, second, HOW)
    assert loss == pytest.approx(want, abs=1e-8)
    assert np.allclose(g, slope, atol=1e-5)


def test_loss_is_that_of_the_metrics(spark):
    """All parts, the curvature too, on one tile."""
    cells = table(spark, grids(1, seed=3))
    first, second = np.array([0.2, -0.1, 0.3]), np.array([0.1, 0.4, -0.2])
    how = Training(curvature=0.5)
    loss, _ = training.gradient(training.loss_terms(cells, FEATURES, curvature=True), first, second, how)
    done = training.apply_state(cells, {"first": first, "second": second}, FEATURES)
    want = metrics.total_loss(done, "stage1", "stage2", weights=(1.0, 0.1, 0.2, 0.5)).first().loss
    assert loss == pytest.approx(want, abs=1e-8)


def test_query(spark):
    from terrasift.plans.queries import QUERIES

    rows = QUERIES["train_epochs"](spark, "/root/testdata/sf0.01").orderBy("epoch").collect()
    assert [r.epoch for r in rows] == [1, 2, 3, 4, 5, 6]
    assert rows[-1].train_loss < rows[0].train_loss


def test_epochs_equal_a_plain_loop_and_resumed_runs_equal_unbroken_ones(spark):
    data, held = grids(4), grids(2, seed=9)
    cells, val = table(spark, data), table(spark, held)
    whole, broken = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(2))
    got = training.train(cells, val, whole, FEATURES, HOW).orderBy("epoch").collect()
    first, second, m, v = np.zeros(3), np.zeros(3), np.zeros(6), np.zeros(6)
    gt, coarse, mask, x = held
    for epoch, row in enumerate(got, 1):
        loss, g = plain_loss(data, first, second, HOW)
        g *= min(1, 1 / (math.sqrt(g @ g) + 1e-6))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 1e-6 + (0.05 - 1e-6) * (1 + math.cos(math.pi * (epoch - 1) / 6)) / 2
        theta = np.r_[first, second] - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        first, second = theta[:3], theta[3:]
        error = (np.concatenate([x, np.ones((*mask.shape, 1))], -1) @ (first + second) + coarse - gt)[mask]
        assert row["train_loss"] == pytest.approx(loss, abs=1e-4)
        assert row["mask_rmse"] == pytest.approx(math.sqrt((error**2).mean()), abs=1e-4)
    assert got[-1]["train_loss"] < got[0]["train_loss"] * 0.9
    # stopped after four epochs, then on over other partitions
    training.train(cells, val, broken, FEATURES, HOW, until=4)
    again = training.train(cells.repartition(7), val.repartition(3), broken, FEATURES, HOW).orderBy("epoch").collect()
    assert again == got
    assert training.load_state(spark, whole, "latest") == training.load_state(spark, broken, "latest")


def test_kept_states(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    done = training.train(table(spark, grids(2)), None, path, FEATURES, Training(epochs=5, learning_rate=0.05, save_every=2, batches=2, schedule="step"))
    rows = done.orderBy("epoch").collect()
    assert [r["epoch"] for r in rows] == [1, 2, 3, 4, 5]
    assert [r["mask_rmse"] for r in rows] == [None] * 5
    best = min(rows, key=lambda r: (r["train_loss"], r["epoch"]))["epoch"]
    assert set(training._stored(spark, path, "state")) == {2, 4, 5, best}
    assert training.load_state(spark, path).epoch == best
    with pytest.raises(LookupError):
        training.load_state(spark, path, 77)


def test_rates():
    how = Training(epochs=9, learning_rate=1.0, schedule="step")
    assert [round(how.rate(d), 4) for d in (0, 2, 3, 6, 9)] == [1.0, 1.0, 0.3, 0.09, 0.027]
    assert Training(schedule=None).rate(50) == 4e-4
    assert Training().rate(200) == pytest.approx(1e-6)
    with pytest.raises(ValueError):
        Training(schedule="other").rate(0)


def test_gaps_and_empty_tables(spark):
    """Cells without truth have no terms, missing features are 0, and nothing at all is an error."""
    cells = table(spark, grids(1))
    gap = cells.withColumn("gt", F.when(F.col("row") != 4, F.col("gt"))).withColumn("u", F.when(F.col("col") > 2, F.col("u")))
    terms = training.loss_terms(gap, FEATURES)
    assert terms.where("t is null or exists(f, x -> x is null)").count() == 0
    holes = gap.where("mask and gt is not null").count()
    assert terms.where("kind = 0").count() == holes
    with pytest.raises(ValueError):
        training.train(cells.limit(0), None, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), FEATURES)


def test_state_as_columns(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    data = grids(2)
    cells = table(spark, data)
    training.train(cells, None, path, FEATURES, Training(epochs=2, learning_rate=0.1))
    state = training.load_state(spark, path, "latest")
    gt, coarse, mask, x = data
    out = training.apply_state(cells, state, FEATURES).collect()
    full = np.concatenate([x, np.ones((*mask.shape, 1))], -1)
    for r in out[::7]:
        at = r["tile"], r["row"], r["col"]
        want = coarse[at] + mask[at] * (full[at] @ (np.array(state["first"]) + np.array(state["second"])))
        assert r["stage2"] == pytest.approx(want)
