"""Exact dedup with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import unused


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """Marks one row of each group of byte-identical texts as the one that stays.

    Rows are grouped by a 128-bit content hash together with the text itself, so bytes are
    compared inside each group and a hash collision cannot join two texts. Copies collapse
    in each task before the shuffle, whatever their number. The rows then find their group
    by hashes of the text; texts are shuffled once, and only once per task and text.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row with an id.
    Null text counts as empty; rows with a null id are left out, as no result can name them.
    Equal rows with one id are all kept or all dropped. keep: "largest" or "smallest" id.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = rows.withColumn("h", F.unhex(F.md5("text")))
    pick = F.max if keep == "largest" else F.min
    groups = hashed.groupBy("h", "text").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size")).select("h", F.unhex(F.sha2("text", 256)).alias("s"), "keep_id", "group_size")
    found = hashed.select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("s")).join(groups, ["h", "s"])
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("s")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; rows without an id stay. A row goes by its id and text, so other
    texts of the same id aren't touched."""
    gone_id, gone_text = unused(docs, "gone_id", "gone_text")
    gone = exact_dedup(docs, id_col, text_col, keep).where("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_text)).distinct()
    same = (F.col(f"`{id_col}`") == F.col(gone_id)) & (F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256) == F.col(gone_text))
    return docs.join(gone, same, "left_anti")
