"""Quality by a document classifier combined with host and path posteriors (hierarchical empirical Bayes)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import settled
from .linear import SAMPLE_ROWS, features, fit, labelled_sample
from .text import slices, utf8

KEEP_AT = 0.5
#: The least and most pseudo-documents by which a site is drawn to the level above it.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0


def _strength(mean: float, spread: float, inverse_n: float) -> float:
    """Pseudo-documents of a beta prior with that mean, from the spread of site means about it (method of moments)."""
    inside = mean * (1 - mean)
    between = max(spread - inside * inverse_n, 1e-9)
    return min(max(inside / between - 1, LEAST_STRENGTH), MOST_STRENGTH)


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(sites, mean, host_strength, path_strength) from rows (host, path, p).

    sites: number and sum of p of each path and of its host, over all rows, aggregated in each task
    first. Only the mean and the two strengths pass through the driver.
    """
    paths = settled(scored.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("p").alias("path_sum")))
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_sum").alias("host_sum"))
    mean = hosts.agg(F.sum("host_sum") / F.sum("host_n")).first()[0]
    if mean is None:
        mean = 0.5
    host_mean, path_mean = F.col("host_sum") / F.col("host_n"), F.col("path_sum") / F.col("path_n")
    spread, inverse = hosts.agg(F.avg(F.pow(host_mean - mean, 2)), F.avg(1 / F.col("host_n"))).first()
    host_strength = _strength(mean, spread or 0.0, inverse or 1.0)
    sites = paths.join(hosts, "host")
    spread, inverse = sites.agg(F.avg(F.pow(path_mean - host_mean, 2)), F.avg(1 / F.col("path_n"))).first()
    return sites, mean, host_strength, _strength(mean, spread or 0.0, inverse or 1.0)


def quality(docs: DataFrame, labels: DataFrame, host: F.Column, path: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = SAMPLE_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, doc_score, host_score, path_score, score, keep; one row per row of docs with an id.

    doc_score: a linear classifier's probability of good text. host_score: mean of the other
    documents' scores on the host, drawn to the global mean; path_score: that of the other
    documents on the host's path, drawn to host_score. Both strengths are estimated from the spread of
    all sites (empirical Bayes), so sparse sites stay near the level above. score adds the
    log-odds by which the path departs from the global mean to those of the document. Sites are
    summed over all documents; a null host or path is a site of its own. Texts that are null or
    empty get their score from the model's intercept and their site; with labels of one class only,
    or none (0.5), all documents score alike. Long texts count whole. Rows that repeat an id are scored and counted each; a score
    right at keep_at keeps. Other columns aren't looked at. The strengths lie between LEAST_STRENGTH and MOST_STRENGTH.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(host.cast("string"), F.lit("\0")).alias("host"), F.coalesce(path.cast("string"), F.lit("\0")).alias("path"))
    sample = labelled_sample(rows, labels.select(F.col(id_col).alias("doc_id"), label_col), "doc_id", "text", [label_col], bound)
    y = sample.y[label_col]
    model = fit(sample.offsets, sample.index, sample.shapes, y, float(np.mean(y)) if len(y) else 0.5)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(*utf8(batch["text"])):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["host"], part["path"], pa.array(model(*features(data, off)))], ["doc_id", "host", "path", "p"])

    scored = settled(rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, host string, path string, p double"))
    sites, mean, host_strength, path_strength = site_posteriors(scored)
    x, one, p = scored.join(sites, ["host", "path"]), F.lit(1.0), F.col("p")
    x = x.withColumn("host_score", (F.col("host_sum") - p + host_strength * mean) / (F.col("host_n") - 1 + host_strength))
    x = x.withColumn("path_score", (F.col("path_sum") - p + path_strength * F.col("host_score")) / (F.col("path_n") - 1 + path_strength))

    def logit(c):
        c = F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(c / (one - c))

    z = logit(p) + logit(F.col("path_score")) - logit(F.lit(mean))
    score = one / (one + F.exp(-z))
    return x.select("doc_id", p.alias("doc_score"), "host_score", "path_score", score.alias("score"), (score >= keep_at).alias("keep"))
