"""Voids in sequence against plain loops over cells."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.functions.columns import uniform
from terrasift.operators import voids


def u(*keys):
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16) / 2**32


def whole(low, high, *keys):
    return low + int(u(*keys) * (high - low))


def plain(ok, weight, strategy, coverage, name):
    """The same by sets of cells."""
    h, w = ok.shape
    valid = [(r, c) for r in range(h) for c in range(w) if ok[r, c]]
    if not valid:
        return set(), True
    target = max(1, int(len(valid) * (coverage[0] + (min(coverage[1], 0.9) - coverage[0]) * u(0, "target", name))))
    inside = lambda p: 0 <= p[0] < h and 0 <= p[1] < w

    def disk(at, radius):
        return {(r, c) for r in range(h) for c in range(w) if (r - at[0]) ** 2 + (c - at[1]) ** 2 <= radius**2}

    def wider(cells, steps):
        for _ in range(steps):
            cells = cells | {p for r, c in cells for p in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)) if inside(p)}
        return cells

    total = sum(weight[p] for p in valid)
    if strategy == "vegetation_priority" and total <= 0:
        strategy = "irregular"
    mask = set()
    for k in range(64 if strategy == "block" else 200):
        if strategy == "block":
            a, b = whole(max(8, h // 12), max(12, h // 4), 0, "high", name, k), whole(max(8, w // 12), max(12, w // 4), 0, "wide", name, k)
            top, left = whole(0, max(1, h - a), 0, "row", name, k), whole(0, max(1, w - b), 0, "col", name, k)
            mask |= {(r, c) for r in range(top, min(top + a, h)) for c in range(left, min(left + b, w))}
        elif strategy == "irregular":
            mask |= disk(valid[whole(0, len(valid), 0, "place", name, k)], whole(6, 24, 0, "radius", name, k))
            if u(0, "widened", name, k) < 0.75:
                mask = wider(mask, whole(1, 4, 0, "steps", name, k))
        else:
            rest, at = u(0, "weight", name, k) * total, None
            for r in range(h):
                for c in range(w):
                    if ok[r, c] and at is None:
                        rest -= weight[r, c]
                        at = (r, c) if rest < 0 else None
            mask |= wider(disk(at, whole(8, 28, 0, "radius", name, k)), whole(1, 3, 0, "steps", name, k))
        mask = {p for p in mask if ok[p]}
        if len(mask) >= target:
            return mask, True
    return mask, False


@pytest.mark.parametrize("strategy", voids.STRATEGIES)
def test_against_plain_loops(spark, strategy):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for t, (h, w) in enumerate([(40, 50), (9, 30), (1, 7), (64, 20)]):
        ok, weight = rng.random((h, w)) < 0.8, np.where(rng.random((h, w)) < 0.1, rng.integers(1, 9, (h, w)), 0).astype(float)
        if t == 3:
            weight[:] = 0
        want[f"w{t}"] = plain(ok, weight, strategy, (0.2, 0.6), f"w{t}")
        rows += [(f"w{t}", r, c, bool(ok[r, c]), float(weight[r, c])) for r in range(h) for c in range(w)]
    rows += [("none", 0, c, None, None) for c in range(3)]
    df = spark.createDataFrame(rows, "tile string, row int, col int, ok boolean, weight double").repartition(7)
    got = voids.voids_in_sequence(df, strategy, (0.2, 0.6), "ok", "weight").toPandas()
    assert len(got) == len(rows) and not got.loc[got["tile"] == "none", "void"].any()
    for name, (mask, met) in want.items():
        own = got[got["tile"] == name]
        assert {(r.row, r.col) for r in own[own["void"]].itertuples()} == mask and set(own["reached"]) == {met}


def test_draws_agree_with_columns(spark):
    row = spark.range(1).select(uniform(F.lit(7), F.lit("a"), F.lit("tile x"), F.lit(3)).alias("u")).first()
    assert row.u == voids.draw(7, "a", "tile x", 3)


def test_shapes_that_run_out_are_told(monkeypatch):
    monkeypatch.setattr(voids, "RECTANGLES", 1)
    ok = np.ones((100, 100), bool)
    mask, met = voids.voids_of_window(ok, None, "block", (0.8, 0.9), 0, "w")
    assert not met and 64 <= mask.sum() <= 625


def test_strategies_by_column(spark):
    df = spark.range(2 * 400).select(F.concat(F.lit("w"), F.floor(F.col("id") / 400)).alias("tile"), F.floor(F.col("id") % 400 / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"))
    df = df.withColumn("strategy", F.when(F.col("tile") == "w0", "block").otherwise("irregular"))
    got = voids.voids_in_sequence(df).toPandas()
    for t, s in (("w0", "block"), ("w1", "irregular")):
        own = got[got["tile"] == t]
        mask, _ = plain(np.ones((20, 20), bool), np.zeros((20, 20)), s, (0.05, 0.22), t)
        assert {(r.row, r.col) for r in own[own["void"]].itertuples()} == mask
    with pytest.raises(ValueError):
        voids.voids_in_sequence(df, "spiral")
