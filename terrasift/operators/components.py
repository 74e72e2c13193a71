"""Connected components of flagged cells (4-neighbourhood)."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lines import whole_groups

#: Blocks of cells that are labelled as a whole have sides of two to this power.
BLOCK_BITS = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local one is set, but only on one machine; elsewhere that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the folder of spark.checkpoint.dir."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(spark: SparkSession, path: str) -> list[str]:
    """The names of the tables right below path whose writing is complete."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that was written below the shared folder and that no plan reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _least_labels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(tile, node, label): the least node connected with each. A round takes the least label of the neighbours,
    then that label's own label, so long chains halve each time."""
    both = settled(edges.select("tile", F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select("tile", F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = settled(nodes.withColumn("label", F.col("node")))
    for _ in range(max_rounds):
        seen = both.join(labels.select("tile", F.col("node").alias("y"), "label"), ["tile", "y"]).groupBy("tile", F.col("x").alias("node")).agg(F.min("label").alias("best"))
        step = labels.join(seen, ["tile", "node"], "left").select("tile", "node", F.col("label").alias("old"), F.least("label", "best").alias("label"))
        jump = step.select("tile", F.col("node").alias("label"), F.col("label").alias("far"))
        new = settled(step.join(jump, ["tile", "label"], "left").select("tile", "node", "old", F.least("label", "far").alias("label")))
        changed = new.where("old != label").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels
    raise RuntimeError("labels did not settle")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n can reach by the pairs."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        for side in (a, b, root[a], root[b]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _in_blocks(batches: Iterator[pa.RecordBatch], flag: str) -> Iterator[pa.RecordBatch]:
    """Adds to whole blocks of cells _part: for flagged ones the place of the first cell that each is connected with in its block."""
    for table, starts in whole_groups(batches, ["tile", "_br", "_bc"]):
        own = np.flatnonzero(pc.fill_null(table[flag], False).to_numpy())
        block = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, table.num_rows]))[own]
        row, col = (table[c].to_numpy().astype(np.int64)[own] for c in ("row", "col"))
        # a block is at most 2**BLOCK_BITS wide: its number and a place in it as one number, which rises with the cells
        low = (1 << BLOCK_BITS) - 1
        key = (block << (2 * BLOCK_BITS + 2)) | ((row & low) << (BLOCK_BITS + 1)) | (col & low)
        pairs = []
        for step in (1, 1 << (BLOCK_BITS + 1)):
            at = np.searchsorted(key, key + step)
            met = np.flatnonzero(np.r_[key, -1][at] == key + step)
            pairs.append((met, at[met]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        first = _roots(len(key), a, b)
        part, none = np.zeros(table.num_rows, np.int64), np.ones(table.num_rows, bool)
        part[own], none[own] = (row[first] << 32) + col[first], False
        yield from pa.Table.from_arrays([*table.columns, pa.array(part, mask=none)], [*table.column_names, "_part"]).to_batches(max_chunksize=1 << 14)


def label_components(cells: DataFrame, flag: str, out: str = "label") -> DataFrame:
    """Adds to flagged cells the place (row * 2**32 + col) of their component's first cell; NULL to others. A column named like the new one is replaced.

    Square blocks of cells are labelled on their own, each within one task. Components that go over the edge of a block are
    joined by a graph whose nodes are those components of blocks; where no block's edge is touched, there is none.
    """
    side = 1 << BLOCK_BITS
    blocks = cells.drop(out).withColumn("_br", F.floor(F.col("row") / side).cast("int")).withColumn("_bc", F.floor(F.col("col") / side).cast("int"))
    dealt = blocks.repartition("tile", "_br", "_bc").sortWithinPartitions("tile", "_br", "_bc", "row", "col")
    schema = T.StructType([*dealt.schema.fields, T.StructField("_part", T.LongType())])
    parts = settled(dealt.mapInArrow(lambda b: _in_blocks(b, flag), schema).drop("_br", "_bc"))
    # cells on both sides of a block's edge
    pairs = []
    for along, across in (("row", "col"), ("col", "row")):
        edge = parts.where(F.col("_part").isNotNull())
        before = edge.where(F.col(across) % side == side - 1).select("tile", F.col(along).alias("_k"), (F.col(across) + 1).alias("_x"), F.col("_part").alias("a"))
        after = edge.where((F.col(across) % side == 0) & (F.col(across) > 0)).select("tile", F.col(along).alias("_k"), F.col(across).alias("_x"), F.col("_part").alias("b"))
        pairs.append(before.join(after, ["tile", "_k", "_x"]).select("tile", "a", "b"))
    edges = settled(pairs[0].unionByName(pairs[1]).distinct())
    if edges.isEmpty():
        return parts.withColumnRenamed("_part", out)
    nodes = edges.select("tile", F.col("a").alias("node")).unionByName(edges.select("tile", F.col("b").alias("node"))).distinct()
    labels = _least_labels(nodes, edges).select("tile", F.col("node").alias("_part"), F.col("label").alias("_joined"))
    return parts.join(labels, ["tile", "_part"], "left").withColumn(out, F.coalesce("_joined", "_part")).drop("_part", "_joined")


def component_sizes(labelled: DataFrame, label: str = "label", out: str = "area") -> DataFrame:
    """Adds the number of cells of the cell's component. Sizes are aggregated and joined back, so that a
    component of most cells is not one window partition."""
    size = labelled.where(F.col(label).isNotNull()).groupBy("tile", label).agg(F.count("*").alias(out))
    return labelled.join(size, ["tile", label], "left")
