"""Shared plumbing: scratch space that all executors see, connected components, split groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import discard, settled, shared_dir, written

__all__ = ["block_pairs", "connected_components", "discard", "roots", "scratch", "settled", "shared_dir", "stored", "unused", "whole_groups", "written"]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Those names, each with as many underscores before it as keep it apart from the columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows, written as a table below the shared folder and read from there."""
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    edges has columns a, b of one type. Alternates the large-star and small-star steps
    (Kiveris et al., 2014), which need a number of rounds logarithmic in the nodes and
    never gather a component: each step is an aggregated minimum and a join that the
    adaptive planner may split. Nulls and loops are ignored.
    """
    e = settled(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = settled(small.distinct())
        # a fixed point has the same edges; their number and sums are a cheap test for that
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n can reach by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def block_pairs(df: DataFrame, blocks: str, salt: str) -> DataFrame:
    """Deals each group out to pairs of blocks, so that any two of its rows meet in exactly one
    pair that can decide about them.

    blocks: column with the number of blocks of the row's group (1: unsplit). salt: a value by
    which rows are dealt to blocks. Adds own (the row's block), lo and hi (the pair).
    """
    own = F.pmod(F.xxhash64(F.col(salt)), F.col(blocks).cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))
    return df.withColumn("own", own).withColumn("other", other).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], rows: int = 4096, weight: str | None = None, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Feeds work with tables of whole groups from a partition that is sorted by keys.

    A table is passed on once it holds that many rows, or that much of the weight column; one
    group is bounded by whoever dealt the groups out.
    """
    held: list[pa.Table] = []
    count = heavy = 0

    def cut(table: pa.Table) -> int:
        same = np.ones(table.num_rows, bool)
        for k in keys:
            c = table[k].to_numpy()
            same &= c == c[-1]
        return int(np.argmin(same[::-1])) if not same.all() else table.num_rows

    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            t = pa.Table.from_batches([batch.slice(lo, rows)])
            held.append(t)
            count += t.num_rows
            heavy += int(np.sum(t[weight].to_numpy())) if weight else 0
            if count >= rows or heavy >= most:
                table = pa.concat_tables(held)
                tail = cut(table)
                if tail < table.num_rows:
                    yield from work(table.slice(0, table.num_rows - tail))
                    table = table.slice(table.num_rows - tail)
                held, count = [table], table.num_rows
                heavy = int(np.sum(table[weight].to_numpy())) if weight else 0
    if count:
        yield from work(pa.concat_tables(held))
