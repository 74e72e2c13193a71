"""Tables of cells that are patched where they lie, and counters of the pass that writes."""

import os

import pytest
from pyspark.sql import functions as F

from terrasift.sources import tables


def table(spark, path):
    """Tiles 001 and 002, of which the second has gaps; 003 misses a band altogether."""
    rows = [(f"00{t}", r, c, None if t == 2 and r == c else float(t * 100 + r * 10 + c), None if t == 3 else 1.0) for t in (1, 2, 3) for r in range(5) for c in range(6)]
    cells = spark.createDataFrame(rows, "tile string, row int, col int, z double, w double")
    tables.write_cells(cells, path, ["z", "w"])
    return cells


def files(path):
    return {f"{d[len(path):]}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_tiles_with_gaps_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/cells"
    table(spark, f"file://{path}")
    before = files(path)
    report = {(r.tile, r.band): r.filled for r in tables.patch_in_place(spark, f"file://{path}", ["z", "w"]).collect()}
    assert report == {("002", "z"): 5, ("002", "w"): 0, ("003", "z"): 0, ("003", "w"): 30}
    after = files(path)
    old = {k: v for k, v in before.items() if "tile=001" in k}
    assert old and {k: v for k, v in after.items() if "tile=001" in k} == old
    assert not {k for k in before if "tile=002" in k} & set(after)
    got = spark.read.schema("row int, col int, z double, w double, tile string").parquet(f"file://{path}").collect()
    assert len(got) == 90 and all(r.z is not None and r.w == (0.0 if r.tile == "003" else 1.0) for r in got)
    near = {(r.row, r.col): r.z for r in got if r.tile == "002"}
    # ties go to the least row, then col: the cell above, or for the first row the one on the right
    assert near[0, 0] == 201.0 and near[2, 2] == 212.0 and near[4, 4] == 234.0
    again = files(path)
    assert tables.patch_in_place(spark, f"file://{path}", ["z", "w"]).count() == 0 and files(path) == again


def test_a_failed_run_leaves_the_old_tiles(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/cells"
    table(spark, f"file://{path}")
    before = files(path)
    lost = lambda c, band, out: c.withColumn(out, F.when(F.col("col") < 3, F.col(band)).otherwise(F.expr("raise_error('lost')").cast("double")))
    monkeypatch.setattr(tables, "nearest_fill", lost)
    with pytest.raises(Exception, match="lost"):
        tables.patch_in_place(spark, f"file://{path}", ["z"])
    assert files(path) == before


def test_counters_come_from_the_writing_pass(spark, tmp_path):
    """One scan: the rows that are read in all are those of the table, once."""
    table(spark, f"file://{tmp_path}/cells")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    cells = spark.read.schema("row int, col int, z double, w double, tile string").parquet(f"file://{tmp_path}/cells")
    seen = tables.write_observed(cells.mapInArrow(counted, cells.schema), f"file://{tmp_path}/out", tables.cell_counters(["z", "w"]), by=["tile"])
    assert seen == {"cells": 90, "z_there": 85, "z_missing": 5, "w_there": 60, "w_missing": 30} and read.value == 90
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 90


def test_meta_is_parsed_with_a_default(spark):
    rows = [("a", '{"sample_id": "x", "tile_id": "t", "row": 3, "mask_ratio": 0.25, "more": [1]}'), ("b", None), ("c", "no json"), ("d", "{}"), ("e", '{"row": "wide"}')]
    got = {r.sample_id: r.meta for r in tables.parsed_meta(spark.createDataFrame(rows, "sample_id string, meta string"), path=F.lit("p")).collect()}
    assert (got["a"].sample_id, got["a"].path, got["a"].tile_id, got["a"].row, got["a"].mask_ratio, got["a"].split) == ("x", "p", "t", 3, 0.25, None)
    for k in "bcde":
        assert (got[k].sample_id, got[k].path, got[k].row) == (k, "p", None)
