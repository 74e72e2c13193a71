"""Learned repair: a regression on cell features in place of a network, and the residual form around any predictor."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_residual(cells: DataFrame, features: list[str], gt: str = "gt", coarse: str = "coarse", mask: str = "mask", l2: float = 1e-6):
    """A linear model of gt - coarse over masked cells, fitted by Spark on all of them (one pass over the data)."""
    rows = cells.where(F.col(mask)).select(*[F.col(f).cast("double").alias(f) for f in features], (F.col(gt) - F.col(coarse)).alias("residual")).na.drop()
    data = VectorAssembler(inputCols=features, outputCol="x").transform(rows)
    return LinearRegression(featuresCol="x", labelCol="residual", regParam=l2, solver="normal").fit(data)


def residual(model, features: list[str]) -> Column:
    """The model as a column expression, so that scoring stays in generated code."""
    total = F.lit(float(model.intercept))
    for f, w in zip(features, model.coefficients, strict=True):
        total = total + F.coalesce(F.col(f), F.lit(0.0)) * F.lit(float(w))
    return total


def repair(cells: DataFrame, stages: list[Column], coarse: str = "coarse", mask: str = "mask") -> DataFrame:
    """stage1, stage2, ...: each adds its residual to the one before within the mask only, so other cells keep the coarse surface."""
    out, before = cells, F.col(coarse)
    for i, r in enumerate(stages, 1):
        out = out.withColumn(f"stage{i}", F.when(F.col(mask), before + r).otherwise(before))
        before = F.col(f"stage{i}")
    return out
