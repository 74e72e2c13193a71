"""Byte-level BPE encoding and decoding by overlapping chunks."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import PieceEncoder

#: Characters in a chunk, and by how many the next one overlaps it.
CHUNK, OVERLAP = 32768, 1024
#: Of pieces and their ids in each worker, which keeps them while it lives, other stages included.
CACHE_BYTES = 48 << 20
#: Characters of chunks that a task hands on at once.
_HELD = 1 << 20
_encoders: dict[tuple[str, str], tuple] = {}


def encoder(rank_file: str, pattern: str):
    """(PieceEncoder, tiktoken encoding) of a rank file; made once in each worker."""
    if (rank_file, pattern) not in _encoders:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _encoders[rank_file, pattern] = PieceEncoder(lambda pieces: [array("I", enc.encode_ordinary(p)).tobytes() for p in pieces], 4, CACHE_BYTES), enc
    return _encoders[rank_file, pattern]


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    names, types = ["doc_id", "h", "i", "chunk"], [pa.int64(), pa.string(), pa.int32(), pa.string()]
    rows: list[tuple] = []
    for batch in batches:
        for doc, h, text in zip(batch["doc_id"], batch["h"], batch["text"], strict=True):
            text = text.as_py()
            for i, at in enumerate(range(0, len(text), chunk)):
                rows.append((doc.as_py(), h.as_py(), i, text[at : at + chunk + overlap]))
                if len(rows) * (chunk + overlap) >= _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _boundaries(batches: Iterator[pa.RecordBatch], pattern: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Adds head and tail: the ends of pre-tokens in the stretches that the chunk shares with the one before
    and the one after, from the start of either stretch. Only ends after other than white space count, as
    text may be cut there without changing pre-tokens, and not the last two, which more text might move."""
    import regex

    find = regex.compile(pattern).finditer
    for batch in batches:
        heads, tails = [], []
        for text in batch["chunk"].to_pylist():
            ends = [m.end() for m in find(text)]
            if len(text) > chunk:
                ends = ends[:-2]
            ends = [e for e in ends if not text[e - 1].isspace()]
            heads.append([e for e in ends if e <= overlap])
            tails.append([e - chunk for e in ends if e > chunk])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], [*batch.schema.names, "head", "tail"])


def _encode(batches: Iterator[pa.RecordBatch], rank_file: str, pattern: str, keys: list[str]) -> Iterator[pa.RecordBatch]:
    pieces, enc = encoder(rank_file, pattern)
    for batch in batches:
        coded = pieces.encode(batch["text"])
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            ids = list(islice(coded, part.num_rows))
            back = [enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([*(part[k] for k in keys), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], [*keys, "ids", "decoded"])


def _digest(batches: Iterator[pa.RecordBatch], rank_file: str, pattern: str) -> Iterator[pa.RecordBatch]:
    for b in _encode(batches, rank_file, pattern, ["doc_id"]):
        ids, back = b["ids"].to_pylist(), b["decoded"].to_pylist()
        hashes = [[hashlib.sha256(x).hexdigest() for x in c] for c in (ids, back)]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(hashes[0]), pa.array(hashes[1])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each text whose pieces follow one another: hashes and counts go on from piece to piece, so neither ids nor bytes of a text are ever joined."""
    names = ["doc_id", "h", "n_tokens", "ids_sha256", "decoded_sha256"]
    key, n, hashes, out = None, 0, (), []

    def done() -> None:
        if key is not None:
            out.append((*key, n, *(x.hexdigest() for x in hashes)))

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    for b in batches:
        for doc, h, ids, back in zip(b["doc_id"].to_pylist(), b["h"].to_pylist(), b["ids"], b["decoded"], strict=True):
            if (doc, h) != key:
                done()
                key, n, hashes = (doc, h), 0, (hashlib.sha256(), hashlib.sha256())
            ids = ids.as_buffer()
            n += ids.size // 4
            hashes[0].update(ids)
            hashes[1].update(back.as_buffer())
        if out:
            yield batch()
            out.clear()
    done()
    if out:
        yield batch()


def long_pieces(long: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, h, piece, text): texts longer than a chunk, cut where the pre-tokens of neighbouring chunks meet.

    Chunks are dealt out and pre-tokenised on their own. In the stretch that two chunks share, the
    first boundary that both find is one of the whole text, as pre-tokens from there on depend only
    on what follows. Where none is found (one pre-token fills the stretch), the chunks stay together.
    """
    if overlap >= chunk:
        raise ValueError("the overlap is shorter than a chunk")
    schema = "doc_id long, h string, i int, chunk string"
    chunks = long.mapInArrow(lambda b: _chunks(b, chunk, overlap), schema).repartition("doc_id", "h", "i")
    found = chunks.mapInArrow(lambda b: _boundaries(b, pattern, chunk, overlap), schema + ", head array<int>, tail array<int>")
    doc = Window.partitionBy("doc_id", "h").orderBy("i")
    found = found.withColumn("stitch", F.array_min(F.array_intersect("head", F.lag("tail").over(doc)))).withColumn("next", F.lead("stitch").over(doc)).withColumn("last", F.lead("i").over(doc).isNull())
    # what a chunk adds: from its stitch (its start, if it stays with the one before) to the next one's
    part = F.expr(f"substr(chunk, coalesce(stitch, 0) + 1, case when last then length(chunk) else coalesce(next, 0) + {chunk} end - coalesce(stitch, 0))")
    piece = F.sum(F.when((F.col("i") == 0) | F.col("stitch").isNotNull(), 1).otherwise(0)).over(doc)
    own = found.select("doc_id", "h", "i", piece.alias("piece"), part.alias("part"))
    return own.groupBy("doc_id", "h", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "").alias("text"))


def bpe_digest(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row with an id; null text counts as empty.

    Texts of one chunk are encoded where they are. Longer ones, of any length, go in chunks to several tasks, and their pieces,
    in order, through running hashes, in time linear in their number; of these, equal
    rows are encoded once and returned as often as they are there. Empty tables give none. Other columns aren't looked at.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    short = rows.where(F.length("text") <= chunk).mapInArrow(lambda b: _digest(b, rank_file, pattern), schema)
    long = rows.where(F.length("text") > chunk).withColumn("h", F.md5("text"))
    copies = long.groupBy("doc_id", "h").agg(F.count("*").alias("copies"))
    parts = long_pieces(long.groupBy("doc_id", "h").agg(F.first("text").alias("text")), pattern, chunk, overlap)
    coded = parts.repartition("doc_id", "h", "piece").mapInArrow(lambda b: _encode(b, rank_file, pattern, ["doc_id", "h", "piece"]), "doc_id long, h string, piece long, ids binary, decoded binary")
    order = ["doc_id", "h", "piece"]
    whole = coded.repartition("doc_id", "h").sortWithinPartitions(*order).mapInArrow(_joined, "doc_id long, h string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    whole = whole.join(copies, ["doc_id", "h"]).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return short.unionByName(whole.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
