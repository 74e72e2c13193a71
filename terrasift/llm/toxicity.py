"""Toxicity by a classifier chain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import SAMPLE_ROWS, Model, features, fit, labelled_sample, logit, pick
from .text import slices, utf8

FOLDS = 3
#: Toxic texts are a tenth of the labelled ones; at this probability, held-out rows of the test tables gave under
#: 1 in 1000 clean ones and over 95 in 100 toxic ones.
THRESHOLD = 0.2


class ToxicityChain:
    """One linear model per category, in order; each sees the words of the text and the logits of
    all earlier categories.

    While training, the earlier probabilities are out of fold: a row's come from models that did
    not see it, so that later models don't trust them too much. When scoring, they come from the
    models of all sample rows. A category whose sample lacks a class scores near that class for
    all; without any labels all score 0.
    """

    def __init__(self, categories: list[str], folds: int = FOLDS, bound: int = SAMPLE_ROWS):
        self.categories, self.folds, self.bound = list(categories), folds, bound
        self.models: list[Model] = []

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityChain:
        sample = labelled_sample(docs, labels, id_col, text_col, self.categories, self.bound, self.folds)
        dense, self.models = sample.shapes, []
        for k, name in enumerate(self.categories):
            y = sample.y[name]
            prior = float(y[0]) if len(y) else 0.0
            self.models.append(fit(sample.offsets, sample.index, dense, y, prior))
            if k + 1 < len(self.categories):
                held_out = np.zeros(len(sample))
                for f in range(self.folds):
                    inside, outside = sample.fold != f, sample.fold == f
                    if outside.any():
                        model = fit(*pick(sample, dense, inside), y[inside], prior)
                        held_out[outside] = model(*pick(sample, dense, outside))
                dense = np.column_stack([dense, logit(held_out)])
        return self

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, a row per text and a column per category, and which texts have words."""
        at, index, dense = features(data, offsets)
        out = []
        for model in self.models:
            out.append(model(at, index, dense))
            dense = np.column_stack([dense, logit(out[-1])])
        return np.column_stack(out), np.diff(at) > 0


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], decide_by: str, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with p_<category> columns and toxic (p of decide_by at least the threshold).

    Rows whose text is null or has no words but separators are never toxic. Columns of docs named like
    the new ones are replaced. Rows with a null id are scored like others, but can't be in the sample. Every row is scored by its own
    whole text, however long: rows that repeat an id or text come back as often. A text right at the threshold is toxic.
    """
    chain = ToxicityChain(categories).fit(docs, labels, id_col, text_col)
    names = [f"p_{c}" for c in categories]
    docs = docs.drop(*names, "toxic")
    which = categories.index(decide_by)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(*utf8(batch[text_col])):
                part = batch.slice(lo, hi - lo)
                p, there = chain.predict(data, off)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c) for c in p.T), pa.array(there & (p[:, which] >= threshold))], [*part.schema.names, *names, "toxic"])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("toxic", T.BooleanType())])
    return docs.mapInArrow(score, schema)
