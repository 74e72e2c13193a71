"""Line dedup by overlapping windows of three lines, with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import unused

WINDOW = 3


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, key, gone): the positions of lines that a later occurrence of a window covers.

    A window is that many consecutive lines, not all blank; equal windows are found by 128 bits
    of hash. In the order of (doc_id, text hash, position) the first occurrence stays; the lines
    of every later one go. Occurrences meet only in an aggregated minimum and in a join that
    the adaptive planner may split.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), F.split(text, "\n").alias("l"))
    line = lambda i, k: F.get("l", i + k)
    starts = F.when(F.size("l") >= window, F.sequence(F.lit(0), F.size("l") - window)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[line(i, k) for k in range(window)]).alias("a"), F.xxhash64(F.lit("b"), *[line(i, k) for k in range(window)]).alias("b"), F.length(F.trim(F.concat(*[line(i, k) for k in range(window)]))).alias("n")))
    windows = rows.select("doc_id", "key", F.explode(hashed).alias("w")).where("w.n > 0").select("w.a", "w.b", F.struct("doc_id", "key", "w.pos").alias("at"))
    firsts = windows.groupBy("a", "b").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(firsts, ["a", "b"]).where("at > first").select("at.*")
    return later.select("doc_id", "key", F.explode(F.sequence(F.col("pos"), F.col("pos") + window - 1)).alias("pos")).groupBy("doc_id", "key").agg(F.collect_set("pos").alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the text of each row cut to the lines that stay, and n_removed lines.

    All other columns are as they were; one named n_removed is replaced. Rows with a null id or null text are unchanged;
    texts of fewer lines than a window have none, and long ones count whole. Of rows that repeat one id and text, none counts
    as the later one; of rows that repeat an id with different texts, the one with the smaller text hash comes first.
    """
    docs = docs.drop("n_removed")
    gone_id, gone_key, gone, lines = unused(docs, "gone_id", "gone_key", "gone", "lines")
    found = repeated_lines(docs, id_col, text_col, window).select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key), F.col("gone").alias(gone))
    text = F.col(f"`{text_col}`")
    same = (F.col(f"`{id_col}`") == F.col(gone_id)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(gone_key))
    joined = docs.join(found, same, "left").withColumn(lines, F.when(F.col(gone).isNotNull(), F.split(text, "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    cut = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    out = [F.when(F.col(gone).isNull(), text).otherwise(cut).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*out, F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))
