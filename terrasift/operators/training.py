"""Training over epochs: a linear residual in two stages, fitted by Adam on gradients that Spark sums over all cells.

The loss is that of the shipped training: L1 within the mask for the last stage and half of it for the first, L1 outside, and L1 of
forward differences and of the Laplacian, by weight. The residual acts within the mask only, so all of it is a sum of
w * |f . theta - t| over terms that are made once; a step is one pass over those with two levels of partial sums, and the driver holds
as many numbers as there are parameters. Sums are of whole numbers (2^-30 of a unit), so of the same cells neither the
number of partitions nor a lost executor changes a digit of the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import discard, settled, written
from .metrics import best_epoch
from .repair import repair
from .stencil import laplacian, wc, wr

KEY = ["tile", "row", "col"]
HOLE, VALID, GRADIENT_X, GRADIENT_Y, CURVATURE = range(5)
#: What one unit is in the sums.
_UNIT = float(1 << 30)
_HISTORY = "epoch int, train_loss double, lr double, mask_rmse double"
_STATE = "epoch int, steps int, first array<double>, second array<double>, m array<double>, v array<double>"


@dataclass(frozen=True)
class Training:
    """Settings, with the shipped values. schedule: cosine, step or None. batches: steps an epoch, tiles being dealt anew each time; a batch
    that gets no tile is no step."""

    epochs: int = 200
    learning_rate: float = 4e-4
    schedule: str | None = "cosine"
    least_rate: float = 1e-6
    weight_decay: float = 0.0
    clip: float = 1.0
    save_every: int = 10
    batches: int = 1
    seed: int = 42
    hole: float = 1.0
    valid: float = 0.1
    gradient: float = 0.2
    curvature: float = 0.0

    def rate(self, done: int) -> float:
        """The learning rate once that many epochs are done."""
        if self.schedule == "cosine":
            return self.least_rate + (self.learning_rate - self.least_rate) * (1 + math.cos(math.pi * done / self.epochs)) / 2
        if self.schedule == "step":
            return self.learning_rate * 0.3 ** (done // max(1, self.epochs // 3))
        if self.schedule is None:
            return self.learning_rate
        raise ValueError("schedule is cosine, step or None")

    def weights(self) -> dict[int, float]:
        return {HOLE: self.hole, VALID: self.valid, GRADIENT_X: self.gradient, GRADIENT_Y: self.gradient, CURVATURE: self.curvature}


def loss_terms(cells: DataFrame, features: list[str], curvature: bool = False, gt: str = "gt", coarse: str = "coarse", mask: str = "mask", scale: Column | None = None) -> DataFrame:
    """(tile, kind, f, t, w, n, scale): the loss of a kind is the sum of w * |f . theta - t| by the sum of n, at least 1.

    f has the features and a 1, within the mask. Cells that lack the truth or the coarse surface have no terms, and a missing feature is 0. Cells
    outside the mask make one term a tile.
    """
    m = F.coalesce(F.col(mask).cast("double"), F.lit(0.0))
    f = F.array(*[m * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features], m)
    base = cells.select(*KEY, m.alias("m"), f.alias("f"), (F.col(gt) - F.col(coarse)).cast("double").alias("t"), (scale if scale is not None else F.lit(1.0)).alias("scale"))

    def step(w) -> Column:
        beside = lambda c: F.lead(c).over(w)
        weight = F.greatest(F.col("m"), beside("m"))
        return F.struct(F.zip_with(beside("f"), F.col("f"), lambda a, b: a - b).alias("f"), (beside("t") - F.col("t")).alias("t"), F.when(beside("m").isNotNull(), weight).alias("w"))

    out = base.withColumn("gx", step(wr())).withColumn("gy", step(wc()))
    kinds = {HOLE: F.struct("f", "t", F.col("m").alias("w")), GRADIENT_X: F.col("gx"), GRADIENT_Y: F.col("gy")}
    if curvature:
        for i in range(len(features) + 1):
            out = laplacian(out.withColumn(f"_f{i}", F.get("f", F.lit(i))), f"_f{i}", f"_l{i}")
        out = laplacian(out, "t", "_lt")
        bent = F.array(*[F.coalesce(F.col(f"_l{i}"), F.lit(0.0)) for i in range(len(features) + 1)])
        kinds[CURVATURE] = F.struct(bent.alias("f"), F.coalesce("_lt", F.lit(0.0)).alias("t"), F.col("m").alias("w"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), s["f"].alias("f"), s["t"].alias("t"), s["w"].alias("w")) for k, s in kinds.items()]))
    inside = out.select("tile", "scale", each.alias("x")).where("x.w > 0 and x.t is not null").select("tile", "x.*", F.col("x.w").alias("n"), "scale")
    outside = base.where("t is not null").groupBy("tile").agg((_whole(F.abs("t") * (1 - F.col("m"))) / _UNIT).alias("t"), F.sum(1 - F.col("m")).alias("n"), F.max("scale").alias("scale"))
    none = F.array(*[F.lit(0.0)] * (len(features) + 1))
    return inside.unionByName(outside.select("tile", F.lit(VALID).alias("kind"), none.alias("f"), "t", F.lit(1.0).alias("w"), "n", "scale"))


def _whole(c: Column) -> Column:
    """Sum of a value in whole units."""
    return F.sum(F.round(c * F.lit(_UNIT)).cast("bigint"))


def _dot(theta: np.ndarray) -> Column:
    return reduce(lambda a, b: a + b, [F.get("f", F.lit(i)) * F.lit(float(x)) for i, x in enumerate(theta)])


def _totals(terms: DataFrame, sums: dict[str, Column]) -> dict[int, dict[str, float]]:
    """By kind, the sums in whole units: per partition as long, and those as decimal, so that a partition passes on a row of each kind."""
    per = terms.withColumn("_part", F.spark_partition_id()).groupBy("_part", "kind").agg(*[_whole(c).alias(n) for n, c in sums.items()])
    rows = per.groupBy("kind").agg(*[F.sum(F.col(n).cast("decimal(28,0)")).alias(n) for n in sums]).collect()
    return {r["kind"]: {n: float(r[n]) / _UNIT for n in sums} for r in rows}


def gradient(terms: DataFrame, first: np.ndarray, second: np.ndarray, how: Training) -> tuple[float, np.ndarray] | None:
    """The loss at the parameters of both stages, and its gradient by them, in one pass over the terms; None without terms."""
    e1, e2, w = _dot(first) - F.col("t"), _dot(first + second) - F.col("t"), F.col("w")
    hole = F.col("kind") == HOLE
    sums = {"n": F.col("n"), "l1": F.when(hole, F.abs(e1) * w).otherwise(0.0), "l2": F.abs(e2) * w}
    for i in range(len(first)):
        sums[f"a{i}"] = F.when(hole, F.signum(e1) * w * F.get("f", F.lit(i))).otherwise(0.0)
        sums[f"b{i}"] = F.signum(e2) * w * F.get("f", F.lit(i))
    loss, g1, g2 = 0.0, np.zeros(len(first)), np.zeros(len(first))
    weights, totals = how.weights(), _totals(terms, sums)
    if not totals:
        return None
    for kind, got in sorted(totals.items()):
        share = weights[kind] / max(got["n"], 1.0)
        loss += share * (got["l2"] + 0.5 * got["l1"])
        last = share * np.array([got[f"b{i}"] for i in range(len(first))])
        g1 += last + 0.5 * share * np.array([got[f"a{i}"] for i in range(len(first))])
        g2 += last
    return loss, np.r_[g1, g2]


def mask_rmse(terms: DataFrame, theta: np.ndarray) -> float | None:
    """Root mean square within the mask of all tiles together, in units of the truth; None without tiles."""
    e = (_dot(theta) - F.col("t")) * F.col("scale")
    got = _totals(terms.where(F.col("kind") == HOLE), {"e": e * e * F.col("w"), "n": F.col("n")})
    return math.sqrt(got[HOLE]["e"] / max(got[HOLE]["n"], 1.0)) if got else None


def _stored(spark: SparkSession, path: str, name: str) -> list[int]:
    return [int(n.removeprefix(f"{name}-")) for n in written(spark, path) if n.startswith(f"{name}-")]


def _store(spark: SparkSession, row: tuple, schema: str, path: str) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, train_loss, lr, mask_rmse, selected, best_before, improved) of each epoch that is done; selected is the error of
    held-out tiles within the mask, without such the loss."""
    done = [f"{path}/epoch-{e:05d}" for e in _stored(spark, path, "epoch")]
    rows = spark.read.schema(_HISTORY).parquet(*done) if done else spark.createDataFrame([], _HISTORY)
    return best_epoch(rows.withColumn("selected", F.coalesce("mask_rmse", "train_loss")), "selected")


def _best(spark: SparkSession, path: str) -> int | None:
    last = history(spark, path).where("improved").agg(F.max("epoch")).first()
    return last[0]


def load_state(spark: SparkSession, path: str, which: str | int = "best"):
    """The state of the best epoch, of the latest, or of an epoch that was saved: a row with epoch, first and second; LookupError if there is none."""
    done, states = set(_stored(spark, path, "epoch")), set(_stored(spark, path, "state"))
    epoch = {"best": lambda: _best(spark, path), "latest": lambda: max(done & states, default=None)}.get(which, lambda: which)()
    if epoch not in done & states:
        raise LookupError(f"no state {which!r}")
    return spark.read.schema(_STATE).parquet(f"{path}/state-{epoch:05d}").first()


def _prune(spark: SparkSession, path: str, epoch: int, every: int) -> None:
    """Keeps the states of the latest epoch, the best, and every n-th."""
    best = _best(spark, path)
    for e in _stored(spark, path, "state"):
        if e < epoch and e != best and e % every:
            discard(spark, f"{path}/state-{e:05d}")


def train(cells: DataFrame, held_out: DataFrame | None, path: str, features: list[str], how: Training = Training(), until: int | None = None, scale: Column | None = None) -> DataFrame:
    """Trains from the last epoch that path (a shared folder) has, or from zero, to the last one or until, and returns the history.

    cells, held_out: tile, row, col, gt, coarse, mask and the features. An epoch counts once its row is written, after its state, so a driver that is
    lost starts again with the epoch in which it was and comes to the same numbers. ValueError if no cell has a term.
    """
    spark, p = cells.sparkSession, len(features) + 1
    terms = settled(loss_terms(cells, features, how.curvature > 0, scale=scale))
    held = settled(loss_terms(held_out, features, scale=scale).where(F.col("kind") == HOLE)) if held_out is not None else None
    if terms.isEmpty():
        raise ValueError("no cells to train on")
    first, second, m, v, steps, start = np.zeros(p), np.zeros(p), np.zeros(2 * p), np.zeros(2 * p), 0, 1
    if set(_stored(spark, path, "epoch")) & set(_stored(spark, path, "state")):
        state = load_state(spark, path, "latest")
        if len(state.first) != p:
            raise ValueError("the state has other features")
        first, second, m, v = (np.array(state[n]) for n in ("first", "second", "m", "v"))
        steps, start = state.steps, state.epoch + 1
    for epoch in range(start, min(how.epochs, until or how.epochs) + 1):
        losses = []
        for b in range(how.batches):
            part = terms
            if how.batches > 1:
                part = terms.where(F.pmod(F.xxhash64("tile", F.lit(epoch), F.lit(how.seed)), F.lit(how.batches)) == b)
            if (found := gradient(part, first, second, how)) is None:
                continue
            loss, g = found
            norm = float(np.sqrt(g @ g))
            theta = np.r_[first, second]
            g = g * min(1.0, how.clip / (norm + 1e-6)) + how.weight_decay * theta
            steps += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - how.rate(epoch - 1) * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
            first, second = theta[:p], theta[p:]
            losses.append(loss)
        error = mask_rmse(held, first + second) if held is not None else None
        _store(spark, (epoch, steps, *(x.tolist() for x in (first, second, m, v))), _STATE, f"{path}/state-{epoch:05d}")
        _store(spark, (epoch, sum(losses) / len(losses), how.rate(epoch), error), _HISTORY, f"{path}/epoch-{epoch:05d}")
        _prune(spark, path, epoch, how.save_every)
    return history(spark, path)


def apply_state(cells: DataFrame, state, features: list[str], coarse: str = "coarse", mask: str = "mask") -> DataFrame:
    """Adds stage1 and stage2 by a state that load_state gives, as column expressions."""

    def residual(theta) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * F.lit(float(x)) for f, x in zip(features, theta, strict=False)], F.lit(float(theta[-1])))

    return repair(cells, [residual(state["first"]), residual(state["second"])], coarse, mask)
