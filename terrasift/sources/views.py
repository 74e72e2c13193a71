"""Test inputs as points and cells: lineitem as a point cloud of two tiles, embeddings as 8 x 8 patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, x, y, z, intensity, cls, return_num, num_returns) with coordinates in 64ths, so that sums are exact."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    whole = lambda c: F.floor(c).cast("bigint")
    cls = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (n <= 2), 2).when(F.col("l_returnflag") == "N", 5).when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), 6).otherwise(1)
    points = li.select(
        F.when(k % 2 == 0, "001").otherwise("002").alias("tile"),
        (((k * 7 + p * 3 + n * 11) % 64).cast("double") + (whole(F.col("l_quantity")) % 64).cast("double") / 64).alias("x"),
        (((k * 5 + s * 13 + n * 17) % 64).cast("double") + (F.round(F.col("l_extendedprice") * 100).cast("bigint") % 64).cast("double") / 64).alias("y"),
        ((whole(F.col("l_extendedprice")) % 16384).cast("double") / 64).alias("z"),
        ((p * 37 + s * 101) % 65536).cast("double").alias("intensity"), cls.alias("cls"), n.alias("return_num"),
        F.max(n).over(Window.partitionBy("l_orderkey")).alias("num_returns"),
    )
    dx, dy = F.col("x") - 20, F.col("y") - 44
    return points.where(~((F.col("cls") == 2) & (dx * dx + dy * dy < 81)))


def embedding_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, row, col, z, label, mask): one 8 x 8 patch per vector, masked on rows 2 to 4 and columns 2 to 5."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    c = e.select(F.col("vec_id").alias("tile"), "label", F.posexplode("embedding").alias("p", "v"))
    row, col = F.floor(F.col("p") / 8).cast("int"), (F.col("p") % 8).cast("int")
    return c.select("tile", row.alias("row"), col.alias("col"), F.col("v").cast("double").alias("z"), "label", (row.between(2, 4) & col.between(2, 5)).alias("mask"))


def synthetic_surface(spark: SparkSession, size: int = 256) -> DataFrame:
    """(tile, row, col, z, mask): a smooth analytic surface over [-3, 3] x [-3, 3] with a rectangular mask."""
    c = spark.range(size * size).select(F.lit("synthetic").alias("tile"), F.floor(F.col("id") / size).cast("int").alias("row"), (F.col("id") % size).cast("int").alias("col"))
    x, y = (F.col(a) * (6.0 / (size - 1)) - 3 for a in ("col", "row"))
    bump = lambda a, b: F.exp(-((x - a) * (x - a) + (y - b) * (y - b)))
    z = 120 + 10 * F.sin(1.5 * x) + 8 * F.cos(1.2 * y) - 12 * bump(1.0, -0.5) + 9 * bump(-1.4, 1.1)
    return c.select("tile", "row", "col", z.alias("z"), (F.col("row").between(90, 149) & F.col("col").between(110, 169)).alias("mask"))
