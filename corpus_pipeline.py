"""A corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and has its rows
written as Parquet and read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm.bpe import bpe_digest
from terrasift.llm.cluster import scratch
from terrasift.llm.line_dedup import line_dedup
from terrasift.llm.mixing import mix_documents
from terrasift.llm.ngram_join import keep_one_of_each
from terrasift.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones of docs, doesn't find toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, ["quality", "toxic"], decide_by="toxic").where("not toxic").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of later occurrences of three-line windows; n_chars follows the text."""
    done = line_dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8 or more."""
    return keep_one_of_each(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and hashes of the ids and of the decoded bytes of each document."""
    return bpe_digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("n-gram join", drop_near_copies), ("mixing", mix), ("byte-level BPE", tokenize)]

#: No SQL: the first stage fits a model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, with a table written between them in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{path}/{i}")
        docs = spark.read.parquet(f"{path}/{i}")
    return docs
