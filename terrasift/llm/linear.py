"""Logistic regression on hashed words and byte shares, fitted on a bounded sample of labelled rows.

The sample's sparse features come to the driver, of at most SAMPLE_ROWS rows with at most SAMPLE_BYTES of text
(a word takes no less text than its feature takes memory, or nearly); the fitted weights are a few MB, whatever the input, and go to
the tasks that score all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import slices, utf8, words

#: The most labelled rows that models are fitted on, and the most text that these have together.
SAMPLE_ROWS, SAMPLE_BYTES = 10_000, 64 << 20
#: Values of the hash of a word.
N_WORDS = 1 << 18
#: Standard deviations from the class shares at which a word has a weight.
LEAST_EVIDENCE = 4.0
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_GROUPS = (_SYMBOLS, np.array([48 <= i <= 57 for i in range(256)]), np.array([65 <= i <= 90 for i in range(256)]), np.array([i == 10 for i in range(256)]), np.array([i == 32 for i in range(256)]), np.array([i == 124 for i in range(256)]))
N_SHAPES = len(_GROUPS) + 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, word features of each row, once each; shares of byte groups and log length of each row)."""
    h, at = words(data, offsets, marks=True)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    pair = np.unique((row << 18) | (h >> np.uint64(46)).astype(np.int64))
    size = np.diff(offsets)
    shapes = np.zeros((n, N_SHAPES))
    full = np.flatnonzero(size)
    if len(full):
        for k, group in enumerate(_GROUPS):
            shapes[full, k] = np.add.reduceat(group[data].astype(np.int64), offsets[full]) / size[full]
        shapes[full, -1] = np.log(size[full]) / 10
    return np.r_[0, np.cumsum(np.bincount(pair >> 18, minlength=n))], pair & (N_WORDS - 1), shapes


class Sample:
    """Features and labels of the sample. y: label name to 0/1 array; fold: in which part a row is held out."""

    def __init__(self, offsets, index, shapes, y, fold):
        self.offsets, self.index, self.shapes, self.y, self.fold = offsets, index, shapes, y, fold

    def __len__(self) -> int:
        return len(self.offsets) - 1


def _extract(batches: Iterator[pa.RecordBatch], n_labels: int) -> Iterator[pa.RecordBatch]:
    y = [f"y{i}" for i in range(n_labels)]
    for batch in batches:
        for lo, hi, data, off in slices(*utf8(batch["text"])):
            at, index, shapes = features(data, off)
            part = batch.slice(lo, hi - lo)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(index.astype(np.int32)))
            dense = pa.ListArray.from_arrays(pa.array(np.arange(0, shapes.size + 1, N_SHAPES, dtype=np.int32)), pa.array(shapes.ravel()))
            yield pa.RecordBatch.from_arrays([part["id"], lists, dense, *(part[c] for c in y)], ["id", "index", "shapes", *y])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_cols: list[str], bound: int = SAMPLE_ROWS, folds: int = 3, most_bytes: int = SAMPLE_BYTES) -> Sample:
    """At most bound rows of docs with all labels 0 or 1 and at most most_bytes of text together, the first in the order of a
    hash of the id; the same in each run.

    Labels of ids that docs lack don't count. A label that repeats counts with its larger value. An id that
    repeats in docs counts once, with one of its texts, always the same. Other columns of either table aren't looked at.
    """
    y = [f"y{i}" for i in range(len(label_cols))]
    known = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("int").alias(n) for c, n in zip(label_cols, y, strict=True)]).where("id is not null")
    for n in y:
        known = known.where(F.col(n).isin(0, 1))
    known = known.groupBy("id").agg(*[F.max(n).alias(n) for n in y])
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    sizes = texts.groupBy("id").agg(F.max(F.octet_length("text")).alias("size"))
    order = F.xxhash64("id"), F.col("id")
    # at most bound ids from here on: one task for a running sum, and a broadcast of proven size
    known = known.join(sizes, "id").orderBy(*order).limit(bound)
    known = known.withColumn("total", F.sum("size").over(Window.orderBy(*order))).where(F.col("total") <= most_bytes).drop("size", "total")
    rows = texts.join(F.broadcast(known), "id").groupBy("id", *y).agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least")).select("id", "least.text", *y)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, index array<int>, shapes array<double>" + "".join(f", {n} int" for n in y)
    got = rows.mapInArrow(lambda b: _extract(b, len(y)), schema).toArrow().sort_by("id").combine_chunks()
    if not got.num_rows:
        return Sample(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros((0, N_SHAPES)), {c: np.zeros(0) for c in label_cols}, np.zeros(0, np.int64))
    lists = got["index"].combine_chunks()
    index = lists.flatten().to_numpy()
    counts = np.array(lists.value_lengths())
    y = {c: got[f"y{i}"].to_numpy().astype(float) for i, c in enumerate(label_cols)}
    return Sample(np.r_[0, np.cumsum(counts)], index, got["shapes"].combine_chunks().flatten().to_numpy().reshape(-1, N_SHAPES), y, np.arange(got.num_rows) % folds)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Model:
    """Weights of words, of dense columns (centred and scaled) and an intercept. Without rows of both classes it gives the share of class 1, or a prior."""

    def __init__(self, prior: float):
        self.w = np.zeros(N_WORDS, np.float32)
        self.d, self.centre, self.scale = np.zeros(0), np.zeros(0), np.ones(0)
        self.b = float(logit(np.array(prior)))

    def __call__(self, offsets: np.ndarray, index: np.ndarray, dense: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        z = np.bincount(np.repeat(np.arange(n), np.diff(offsets)), self.w[index], n)
        if len(self.d):
            z += ((dense - self.centre) / self.scale) @ self.d
        return sigmoid(z + self.b)


def _evidence(row: np.ndarray, index: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each word feature, by how many standard deviations the rows that have it depart from the class shares."""
    n, share = len(y), y.mean()
    have = np.bincount(index, minlength=N_WORDS)
    excess = np.bincount(index, y[row], N_WORDS) - have * share
    return np.abs(excess) / np.sqrt(np.maximum(have * share * (1 - share) * (1 - have / n), 0.25))


def fit(offsets: np.ndarray, index: np.ndarray, dense: np.ndarray, y: np.ndarray, prior: float = 0.5, least_evidence: float = LEAST_EVIDENCE, l2: float = 1e-5, steps: int = 300, rate: float = 0.3) -> Model:
    """Adam on the whole sample, over the words that tell the classes apart.

    A word counts once in a row, however long the row is, so a few telling words in a long text weigh as
    much as in a short one. Words with less evidence than least_evidence get no weight, the others are scaled
    by theirs: long rows hold many rare words, whose chance evidence would add up otherwise.
    """
    model = Model(prior)
    if not len(y) or y.min() == y.max():
        return model
    row = np.repeat(np.arange(len(y)), np.diff(offsets))
    z = _evidence(row, index, y)
    tells = (z >= least_evidence)[index]
    row = row[tells]
    used, at = np.unique(index[tells], return_inverse=True)
    value = z[used] / z[used].max(initial=1.0)
    centre, scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-6)
    x = (dense - centre) / scale
    n_w, n_d = len(used), x.shape[1]
    theta = np.zeros(n_w + n_d + 1)
    theta[-1] = logit(np.array(y.mean()))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = np.bincount(row, (theta[:n_w] * value)[at], len(y)) + x @ theta[n_w : n_w + n_d] + theta[-1]
        r = (sigmoid(z) - y) / len(y)
        g = np.r_[np.bincount(at, r[row], n_w) * value, r @ x, r.sum()]
        g[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (1 - t / (steps + 1))
        theta -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    model.w[used] = theta[:n_w] * value
    model.d, model.b, model.centre, model.scale = theta[n_w : n_w + n_d], float(theta[-1]), centre, scale
    return model


def pick(sample: Sample, dense: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of some rows."""
    counts = np.diff(sample.offsets)
    return np.r_[0, np.cumsum(counts[rows])], sample.index[np.repeat(rows, counts)], dense[rows]
