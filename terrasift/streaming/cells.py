"""Cell aggregates of a stream of point files.

Counts, sums and maxima add up, so a micro-batch leaves its partial aggregate as a table of its own,
named by the batch: a batch that runs again replaces its own table, and the state is what lies in
the folder. Time plays no part, so there is no watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import settled
from ..operators.grid import GROUND, KEY, to_cells
from ..sources.las import LasSource


def partial_cells(points: DataFrame, grids: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Sums of one batch; grids is a table that is computed already."""
    g = F.col("cls") == GROUND
    return to_cells(points, grids, resolution, computed=True).groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(g).alias("n_ground"), F.sum(F.when(g, F.col("z"))).alias("sum_ground"), F.max("z").alias("dsm"))


def merged_cells(partials: DataFrame) -> DataFrame:
    done = partials.groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("n_ground").alias("n_ground"), F.sum("sum_ground").alias("s"), F.max("dsm").alias("dsm"))
    return done.select(*KEY, "n", "n_ground", (F.col("s") / F.nullif(F.col("n_ground"), F.lit(0))).alias("dem"), "dsm")


def stream_cells(points: DataFrame, grids: DataFrame, out: str, checkpoint: str, resolution: float = 1.0, trigger: dict | None = None):
    """Starts the stream; out has one partial table per batch."""

    specs = settled(grids)  # computed once, not again by each batch

    def save(batch: DataFrame, batch_id: int) -> None:
        partial_cells(batch, specs, resolution).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return points.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def las_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Points of LAS files as a stream, in the order in which the files arrive."""
    spark.dataSource.register(LasSource)
    return spark.readStream.format("las").options(**options).load(path)


def stream_and_merge(points: DataFrame, grids: DataFrame, path: str, done: Callable[[DataFrame], DataFrame] = merged_cells, resolution: float = 1.0) -> DataFrame:
    """Runs over all files there are and returns the merged cells."""
    stream_cells(points, grids, f"{path}/partials", f"{path}/checkpoint", resolution).awaitTermination()
    return done(points.sparkSession.read.parquet(f"{path}/partials"))
