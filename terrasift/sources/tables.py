"""Tables of cells: precedence between sources, incremental work lists, writing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import to_nodata
from ..operators.components import discard, settled, shared_dir
from ..operators.nearest import nearest_fill


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, or ValueError with the names that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing bands: {', '.join(missing)}")
    return df.select(*columns)


def first_source(listing: DataFrame, order: list[str]) -> DataFrame:
    """Per tile, the row whose source comes first in the order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    ranked = listing.withColumn("_rank", F.when(rank > 0, rank).otherwise(F.lit(len(order) + 1)))
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy("tile").orderBy("_rank", "source"))).where("_n = 1").drop("_rank", "_n")


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a work list that have no output yet; asked before any work."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def write_cells(cells: DataFrame, path: str, bands: list[str], nodata: float | None = None, mode: str = "errorifexists") -> None:
    """Cells as Parquet by tile, so that readers of some tiles prune the rest. nodata: written instead of NULL."""
    out = cells.select("tile", "row", "col", *[(to_nodata(F.col(b), nodata) if nodata is not None else F.col(b)).alias(b) for b in bands])
    out.repartition("tile", F.floor(F.col("row") / 256)).sortWithinPartitions("row", "col").write.partitionBy("tile").option("compression", "zstd").mode(mode).parquet(path)


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Samples (one row each, with a split) as Parquet by split, so that a reader of one prunes the others."""
    samples.write.partitionBy("split").option("compression", "zstd").mode(mode).parquet(path)


def read_samples(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The samples of a split; ValueError if there is no such split."""
    found = spark.read.parquet(path).where(F.col("split") == split)
    if found.isEmpty():
        raise ValueError(f"no split {split!r}")
    return found


def read_cells(spark: SparkSession, path: str, bands: list[str] | None = None) -> DataFrame:
    df = spark.read.option("basePath", path).parquet(path)
    return df if bands is None else require(df, ["tile", "row", "col", *bands])


def write_observed(df: DataFrame, path: str, counters: dict[str, Column], mode: str = "errorifexists", by: list[str] | None = None) -> dict[str, int]:
    """Writes a table as Parquet and returns counters, which are aggregates over all its rows, from the same pass."""
    seen = Observation()
    writer = df.observe(seen, *[c.alias(n) for n, c in counters.items()]).write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return seen.get


def cell_counters(bands: list[str]) -> dict[str, Column]:
    """Counters of cells: all, and for each band those that have it and those that miss it."""
    each = {f"{b}_{n}": c for b in bands for n, c in (("there", F.count(b)), ("missing", F.count_if(F.col(b).isNull())))}
    return {"cells": F.count(F.lit(1)), **each}


def patch_in_place(spark: SparkSession, path: str, bands: list[str]) -> DataFrame:
    """Fills missing cells of bands of a table that write_cells made from the nearest cell, and rewrites only the tiles that have some.

    Returns (tile, band, filled). The new tiles are written beside the table first; then their partitions, and no others, are replaced when
    that job commits, so a job that fails before leaves the old ones. Tiles are texts, as their folders are named.
    """
    found = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField("tile", T.StringType()) if f.name == "tile" else f for f in found.fields])
    cells = spark.read.schema(schema).parquet(path)
    gaps = cells.groupBy("tile").agg(*[F.count_if(F.col(b).isNull()).alias(b) for b in bands])
    gaps = settled(gaps.where(F.greatest(*[F.col(b) for b in bands], F.lit(0)) > 0))
    # partitions without gaps aren't read again: the tiles' names prune them
    out = cells.join(gaps.select("tile"), "tile", "left_semi")
    for b in bands:
        out = nearest_fill(out, b, "_full").withColumn(b, F.col("_full").cast(schema[b].dataType)).drop("_full")
    beside = f"{shared_dir(spark)}/patched-{uuid.uuid4().hex}"
    out.select(*[f.name for f in schema.fields]).write.parquet(beside, compression="zstd")
    new = spark.read.schema(schema).parquet(beside).repartition("tile", F.floor(F.col("row") / 256)).sortWithinPartitions("tile", "row", "col")
    new.write.partitionBy("tile").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)
    discard(spark, beside)
    return gaps.unpivot(["tile"], bands, "band", "filled")


#: What with_meta writes about a sample, besides its id and path.
META = "tile_id string, row int, col int, split string, resolution double, mask_strategy string, mask_ratio double"


def parsed_meta(samples: DataFrame, fields: str = META, path: Column | None = None) -> DataFrame:
    """samples (sample_id, meta) with meta as a struct of sample_id, path and fields. A text that is missing or isn't JSON gives the row's own
    id and path alone, as does one without an id for these two; fields that a text lacks are NULL."""
    own = {"sample_id": F.col("sample_id"), "path": path if path is not None else F.lit(None).cast("string")}
    read = samples.withColumn("_meta", F.from_json("meta", f"sample_id string, path string, {fields}"))
    names = [f.name for f in read.schema["_meta"].dataType.fields]
    return read.withColumn("meta", F.struct(*[F.coalesce(F.col(f"_meta.{n}"), own[n]).alias(n) if n in own else F.col(f"_meta.{n}").alias(n) for n in names])).drop("_meta")
