"""LAS files as a stream and as a sink, and the coordinate systems in their headers."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.sources import files, las


def points(spark, n, seed=1, tiles=3):
    rng = np.random.default_rng(seed)
    rows = [(f"t{i % tiles}", *(float(v) for v in rng.integers(0, 99_000, 3) / 1000), int(i % 500), 1 + i % 3, 3, [2, 5, 6][i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "tile string, x double, y double, z double, intensity int, return_num int, num_returns int, cls int")


def rows(df):
    return sorted((r.tile, round(r.x, 6), round(r.y, 6), round(r.z, 6), r.intensity, r.return_num, r.num_returns, r.cls) for r in df.collect())


def test_round_trip_of_all_columns(spark, tmp_path):
    p = points(spark, 3000)
    heads = las.write_las(p, f"file://{tmp_path}/out", file_points=400)
    assert heads.agg(F.sum("point_count")).first()[0] == 3000 and heads.agg(F.max("point_count")).first()[0] <= 400
    assert rows(spark.read.format("las").option("chunk_size", 150).load(f"file://{tmp_path}/out")) == rows(p)
    las.write_las(p.limit(10), f"file://{tmp_path}/out")
    assert spark.read.format("las").load(f"file://{tmp_path}/out").count() == 3010
    las.write_las(p.where("cls = 2").select("tile", "x", "y", "z"), f"file://{tmp_path}/out", mode="overwrite")
    got = spark.read.format("las").load(f"file://{tmp_path}/out")
    assert got.count() == 1000 and {r.cls for r in got.select("cls").distinct().collect()} == {2}
    assert not [x for x in os.listdir(tmp_path / "out") if x.startswith("_")]
    with pytest.raises(Exception, match="missing columns: z"):
        p.select("tile", "x", "y").write.format("las").mode("append").save(f"file://{tmp_path}/no")


def test_points_of_one_place_are_shared_out(spark, tmp_path):
    """A tile's points aren't written by one task where they are more than Spark gives one (F4, F5)."""
    p = points(spark, 6000, tiles=1).repartition(6)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "40000")
    try:
        heads = las.write_las(p, f"file://{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    # a task writes one file of a tile here
    assert heads.count() > 1 and heads.agg(F.sum("point_count")).first()[0] == 6000
    assert rows(spark.read.format("las").load(f"file://{tmp_path}/out")) == rows(p)


def test_a_failed_job_leaves_no_listed_file(spark, tmp_path):
    spark.dataSource.register(las.LasSource)
    path = f"file://{tmp_path}/out"
    las.write_las(points(spark, 30), path)
    before = sorted(os.listdir(tmp_path / "out"))
    # one of two tasks fails, late
    bad = points(spark, 400).repartition(2).withColumn("z", F.when(F.spark_partition_id() == 0, F.col("z")).otherwise(F.expr("raise_error('lost')").cast("double")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("las").mode("overwrite").save(path)
    assert sorted(os.listdir(tmp_path / "out")) == before
    assert spark.read.format("las").load(path).count() == 30


def test_what_a_lost_task_leaves_does_not_count(tmp_path):
    """A repeated task writes again under other names; only the files that its last message names are moved."""
    import pyarrow as pa

    w = las._Writer({"path": f"file://{tmp_path}"}, False)
    batch = pa.RecordBatch.from_pydict({"tile": ["a", "b", "a"], "x": [1.0, 2.0, 3.0], "y": [0.0] * 3, "z": [5.0] * 3})
    lost, kept = w.write(iter([batch])), w.write(iter([batch]))
    assert files.files_below(f"file://{tmp_path}") == [] and not set(lost.files) & set(kept.files)
    w.commit([kept, None])
    assert sorted(f.rpartition("/")[2] for f in files.files_below(f"file://{tmp_path}")) == sorted(kept.files)
    assert sorted(las.read_header(f)["count"] for f in files.files_below(f"file://{tmp_path}")) == [1, 2]
    again = las._Writer({"path": f"file://{tmp_path}"}, False)
    again.write(iter([batch]))
    again.abort([None])
    assert len(files.files_below(f"file://{tmp_path}")) == 2 and len(os.listdir(tmp_path)) == 2


def test_stream_of_files_in_two_rounds(spark, tmp_path):
    """A restart, and files whose names sort before those that were read."""
    spark.dataSource.register(las.LasSource)
    src, out = f"file://{tmp_path}/in", f"{tmp_path}/out"

    def run():
        s = spark.readStream.format("las").option("chunk_size", 70).option("records_per_batch", 250).load(src)
        q = s.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="0 seconds").start(out)
        q.processAllAvailable()
        n = sum(p.numInputRows for p in q.recentProgress)
        q.stop()
        return n

    first = points(spark, 900, seed=1, tiles=2).withColumn("tile", F.concat(F.lit("m"), "tile"))
    las.write_las(first, src, file_points=300)
    assert run() == 900
    assert rows(spark.read.parquet(out)) == rows(first)
    second = points(spark, 400, seed=2, tiles=2).withColumn("tile", F.concat(F.lit("a"), "tile"))
    las.write_las(second, src)
    assert run() == 400 and run() == 0
    assert rows(spark.read.parquet(out)) == rows(first.unionByName(second))


def test_a_restart_over_all_that_is_available_ends_with_all(spark, tmp_path):
    """Each run asks for one end only, so a bound on records must not cut what came since the last one (F1)."""
    spark.dataSource.register(las.LasSource)
    src, out = f"file://{tmp_path}/in", f"{tmp_path}/out"
    for n in (1, 2, 3):
        las.write_las(points(spark, 400, seed=n), src, file_points=100)
        s = spark.readStream.format("las").option("records_per_batch", 150).load(src)
        s.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(out).awaitTermination()
        assert spark.read.parquet(out).count() == 400 * n
    # the same where Spark plans a batch again that wasn't committed
    r = las._Stream({"path": src, "records_per_batch": "150"})
    every = r._after(r.initialOffset())
    r.partitions(r.initialOffset(), {"time": every[0][0], "file": every[0][1], "record": 7})
    end = r.latestOffset()
    assert (end["time"], end["file"]) == every[-1] and r.partitions(r.initialOffset(), end) and r.at == end


def test_batches_end_within_files(spark, tmp_path):
    """Ranges of any two neighbouring offsets cover each record once, and batches stay within their limit."""
    r = las._Stream({"path": f"file://{tmp_path}", "chunk_size": "70", "records_per_batch": "250"})
    start = r.initialOffset()
    assert r.latestOffset() == start
    for n in (100, 10):
        (tmp_path / f"x{n}.las").write_bytes(las.las_bytes(np.zeros((n, 3))))
    end = r.latestOffset()
    seen = [(p.path, k) for p in r.partitions(start, end) for k in range(p.first, p.first + p.n)]
    assert len(seen) == len(set(seen)) == 110
    for n in (900, 3, 0):
        (tmp_path / f"a{n}.las").write_bytes(las.las_bytes(np.zeros((n, 3))))
    sizes = []
    while (start := end) != (end := r.latestOffset()):
        parts = r.partitions(start, end)
        sizes.append(sum(p.n for p in parts))
        assert max(p.n for p in parts) <= 70
        seen += [(p.path, k) for p in parts for k in range(p.first, p.first + p.n)]
    assert len(seen) == len(set(seen)) == 1013 and max(sizes) == 250 and len(sizes) == 4
    again = las._Stream({"path": f"file://{tmp_path}", "records_per_batch": "5"})
    assert again.latestOffset() == end


def test_patterns_and_folders(spark, tmp_path):
    spark.dataSource.register(las.LasSource)
    for name in ("a.las", "B.LAS", "sub/c.las", "d.bin", "_hidden.las", "sub/_x/e.las"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(las.las_bytes(np.zeros((2, 3))))
    tiles = lambda **o: sorted(r.tile for r in spark.read.format("las").options(headers="true", **o).load(f"file://{tmp_path}").collect())
    assert tiles() == ["B", "a"] and tiles(recursive="true") == ["B", "a", "c"]
    assert tiles(pattern="*.las,a*,*.bin") == ["B", "a", "d"]


def record(user, kind, body):
    return struct.pack("<H16sHH32s", 0, user, kind, len(body), b"") + body


def keys(*entries):
    return struct.pack("<4H", 1, 1, 0, len(entries)) + b"".join(struct.pack("<4H", *e) for e in entries)


P = b"LASF_Projection"


@pytest.mark.parametrize("records,want", [
    ([], None),
    ([record(P, 34735, keys((1024, 0, 1, 1), (3072, 0, 1, 25832)))], "EPSG:25832"),
    ([record(P, 34735, keys((2048, 0, 1, 4326)))], "EPSG:4326"),
    ([record(P, 34735, keys((3072, 0, 1, 32767), (2048, 0, 1, 4258)))], "EPSG:4258"),
    ([record(P, 34735, keys((3072, 34737, 5, 0)))], None),
    ([record(b"other", 34735, keys((3072, 0, 1, 1))), record(P, 2112, b"PROJCS[x]\0")], "PROJCS[x]"),
    ([record(P, 2112, b"\xff\xfe")], None),
    ([record(P, 34735, keys((3072, 0, 1, 25832))[:-3])], None),
    ([record(P, 34735, b"\1\0")], None),
    ([record(P, 34735, keys((3072, 0, 1, 25832)))[:-2]], None),
])
def test_coordinate_systems(spark, tmp_path, records, want):
    spark.dataSource.register(las.LasSource)
    raw, extra = las.las_bytes(np.ones((4, 3))), b"".join(records)
    head = bytearray(raw[: las._HEAD.size])
    struct.pack_into("<I", head, 96, las._HEAD.size + len(extra))
    struct.pack_into("<I", head, 100, len(records))
    (tmp_path / "a.las").write_bytes(bytes(head) + extra + raw[las._HEAD.size :])
    row = spark.read.format("las").option("headers", "true").load(f"file://{tmp_path}").first()
    assert (row.crs, row.point_count) == (want, 4)
    assert spark.read.format("las").load(f"file://{tmp_path}").count() == 4


def test_broken_files_say_so(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(b"LASF too short")
    with pytest.raises(ValueError, match="not a LAS file"):
        las.read_header(f"{tmp_path}/a.las")
    with pytest.raises(ValueError, match="LAZ"):
        las.read_header(f"{tmp_path}/a.laz")
