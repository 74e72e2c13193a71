"""Token-id output: length-delimited binary records with masked checksums and a separate offset index.

A record is a frame: payload bytes (unsigned 64-bit), the masked crc32 of those eight bytes, the
payload, the masked crc32 of the payload; all little-endian. The payload holds the ids of one
document as 16-bit unsigned integers where the vocabulary fits, else 32-bit. The index is a
Parquet table (file, doc_id, offset, n_bytes), by which a reader fetches any record on its own.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import PieceEncoder, joined

#: Bytes that a reader fetches at once of records that follow one another.
RANGE_BYTES = 4 << 20
_HEAD, _CRC = struct.Struct("<QI"), struct.Struct("<I")
_WIDTHS = {2: "<u2", 4: "<u4"}
_encoders: dict[tuple[str, int], tuple[PieceEncoder, int]] = {}


def masked_crc(data: bytes) -> int:
    """The crc32 rotated right by 15 bits plus a constant, so that checksums of checksums differ."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return n + _CRC.pack(masked_crc(n)) + payload + _CRC.pack(masked_crc(payload))


def unframe(record: bytes) -> bytes:
    """The payload of a whole frame; ValueError if any byte is wrong."""
    if len(record) < 16:
        raise ValueError("record cut short")
    n, crc = _HEAD.unpack_from(record)
    if masked_crc(record[:8]) != crc or len(record) != n + 16:
        raise ValueError("wrong record length")
    payload = record[12 : 12 + n]
    if masked_crc(payload) != _CRC.unpack_from(record, 12 + n)[0]:
        raise ValueError("wrong record checksum")
    return payload


def _encoder(tokenizer_file: str, end_id: int) -> tuple[PieceEncoder, int]:
    """The encoder of a tokenizer file and the bytes of an id; made once in each worker."""
    if (tokenizer_file, end_id) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        width = 2 if tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4

        def encode(piece: str) -> np.ndarray:
            return np.array(tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids, _WIDTHS[width])

        def alone(pieces: list[str]) -> list[bytes]:
            return [encode(p).tobytes() for p in pieces]

        end = encode("\n")
        _encoders[tokenizer_file, end_id] = PieceEncoder(joined(encode, int(end[0])) if len(end) == 1 else alone, width), width
    return _encoders[tokenizer_file, end_id]


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def write_token_records(docs: DataFrame, out: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends end_id, writes ranges of ascending ids to files below out and
    returns the index that was written there.

    Each task writes one file under a name of its own and only then reports its records, so a task
    that is lost or repeated leaves at most a file to which no index row points. Null text counts
    as empty, rows with a null id are left out, and empty input makes an empty index. A record holds a whole text, however
    long; rows that repeat an id have a record each, next to each other, in the order of their texts. Other columns aren't written.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = _encoder(tokenizer_file, end_id)
        end = np.array([end_id], _WIDTHS[width]).tobytes()
        sink, at, name = None, 0, ""
        for batch in batches:
            if sink is None:
                name = f"ids-{batch['part'][0].as_py():06d}-{uuid.uuid4().hex}-u{8 * width}.rec"
                fs, path = _open(f"{out}/{name}")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                sink = fs.open_output_stream(path)
            offsets, sizes = [], []
            for ids in encoder.encode(batch["text"]):
                record = frame(ids + end)
                sink.write(record)
                offsets.append(at)
                sizes.append(len(record))
                at += len(record)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(sizes)), batch["doc_id"], pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), batch["part"]], ["file", "doc_id", "offset", "n_bytes", "part"])
        if sink is not None:
            sink.close()

    ordered.mapInArrow(write, "file string, doc_id long, offset long, n_bytes long, part int").write.parquet(f"{out}/index")
    return docs.sparkSession.read.parquet(f"{out}/index")


def read_token_records(spark: SparkSession, out: str, rows: DataFrame | None = None) -> DataFrame:
    """(file, part, offset, doc_id, ids): the records of the index, or of those rows of it, in any order of reading."""
    index = rows if rows is not None else spark.read.parquet(f"{out}/index")
    return index.mapInArrow(lambda b: _records(b, out, False), "file string, part int, offset long, doc_id long, ids array<long>")


def _records(batches: Iterator[pa.RecordBatch], out: str, digest: bool) -> Iterator[pa.RecordBatch]:
    name, source = None, None
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            found = []
            files, offset, size = part["file"].to_pylist(), part["offset"].to_numpy(), part["n_bytes"].to_numpy()
            ends = offset + size
            first = last = 0  # the records first to last - 1 are in data
            for i, file in enumerate(files):
                if file != name:
                    fs, path = _open(f"{out}/{file}")
                    name, source = file, fs.open_input_file(path)
                if i >= last:
                    first, last = i, i + 1
                    while last < len(files) and files[last] == file and offset[last] == ends[last - 1] and ends[last] - offset[first] <= RANGE_BYTES:
                        last += 1
                    data = source.read_at(int(ends[last - 1] - offset[first]), int(offset[first]))
                at = int(offset[i] - offset[first])
                payload = unframe(data[at : at + int(size[i])])
                found.append(np.frombuffer(payload, "<u2" if file.endswith("-u16.rec") else "<u4").astype("<u4"))
            same = [part["file"], part["part"], part["offset"], part["doc_id"]]
            names = ["file", "part", "offset", "doc_id"]
            if digest:
                yield pa.RecordBatch.from_arrays([*same, pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64())], [*names, "n_tokens", "ids_crc32"])
            else:
                yield pa.RecordBatch.from_arrays([*same, pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64()))], [*names, "ids"])


def token_record_digest(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files. start: ids in all records before it."""
    read = spark.read.parquet(f"{out}/index").mapInArrow(lambda b: _records(b, out, True), "file string, part int, offset long, doc_id long, n_tokens long, ids_crc32 long")
    before = Window.unboundedPreceding, -1
    # one row per file: as few as the tasks that wrote
    files = read.groupBy("file", "part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0))).select("file", "base")
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("offset").rowsBetween(*before)), F.lit(0))
    return read.withColumn("inner", inner).join(files, "file").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
