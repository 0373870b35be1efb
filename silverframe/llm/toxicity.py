"""Toxicity scores by a subsequence string-kernel support vector machine.

The machine (:mod:`silverframe.llm.string_kernel`) is fitted on the driver on a bounded sample of labelled
documents, sentence by sentence, and broadcast (8 MB). A sentence's decision is that of its highest-scoring word, a document's
score the calibrated decision of its highest sentence; each distinct word is scored once while the worker remembers it.

Defined cases: null and empty texts score as a text without any match; null ids count as not held out;
repeated rows and ties score alike; an empty table gives no rows; without labels of both classes every
document gets the same score below the threshold (or above, if all labels are toxic); other columns are ignored by
:func:`toxicity`, kept by :func:`without_toxic` and kept by :func:`with_scores` unless they have the score's name, which replaces them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from silverframe.llm import string_kernel as sk
from silverframe.llm.common import batch_texts, by_bytes
from silverframe.llm.labelled import held_out, labelled_sample

_LETTERS = re.compile(r"(?<!\S)(?:[^\w\s]|_)*[^\W\d_](?:[^\w\s]|_)*\s+(?:(?:[^\w\s]|_)+\s+)*(?:[^\w\s]|_)*[^\W\d_](?:[^\w\s]|_)*(?!\S)")
REMEMBERED = 150_000


class WordScores:
    """Highest decision of each text's words, with a bounded memory of words."""

    def __init__(self, model: sk.ToxicityModel):
        self.model, self.known = model, {}

    def highest(self, texts: list[str]) -> np.ndarray:
        split = [sk.words(t) if _LETTERS.search(t) else t.split() for t in texts]
        distinct = set().union(*split)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in distinct if w not in self.known]
        parts = [sk.windows(w) for w in new]
        index: dict[str, int] = {}
        place = np.array([index.setdefault(v, len(index)) for p in parts for v in p], np.int64)
        scores = self.model.decision(list(index))[place]
        sizes = np.array([len(p) for p in parts], np.int64)
        best, some = np.full(len(new), self.model.bias), np.flatnonzero(sizes)
        if len(some):
            best[some] = np.maximum.reduceat(scores, (np.cumsum(sizes) - sizes)[some])
        self.known.update(zip(new, best.tolist(), strict=True))
        return np.array([max(map(self.known.__getitem__, ws), default=self.model.bias) for ws in split])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 20_000) -> sk.ToxicityModel:
    """Fit on at most ``per_class`` labelled documents of each class, of at most ``longest`` characters, whose crc32(doc_id) modulo 3 is not 1."""
    return sk.train(labelled_sample(docs, labels, "toxic", 3, 1, per_class, longest))


def _scored(batches, model: sk.ToxicityModel):
    """(slice of a batch, scores of its texts)."""
    words = WordScores(model)
    for batch in batches:
        for piece in by_bytes(batch, limit=1 << 20):
            yield piece, model.probability(words.highest(batch_texts(piece)))


def without_toxic(docs: DataFrame, model: sk.ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with the columns as they are and no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece, p in _scored(batches, shared.value):
            yield piece.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def with_scores(docs: DataFrame, model: sk.ToxicityModel, column: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1; its other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece, p in _scored(batches, shared.value):
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(p)], [*piece.schema.names, column])

    rest = docs.drop(column).withColumn("text", F.col("text").cast("string"))
    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(column, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold``) of every document."""
    scored = with_scores(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs, labels, per_class))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
