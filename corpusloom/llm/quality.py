"""Quality scores by logistic regression on hashed word n-grams, fitted by FTRL-proximal updates.

Cost at scale: labels are few; a bounded sample of labelled rows is drawn by id, broadcast, and its
texts are learned from once, in one task that holds one text's features at a time. Scoring is a
narrow scan with no shuffle; the model is one weight a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_code
from .wordhash import SAME, mix, utf8, words

BUCKET_BITS = 18
MAX_TRAINING_ROWS = 12_000  # the bound of the sample that the model is fitted on, in expectation
ROWS = 128  # texts worked on at once

#: FTRL-proximal: learning rate, smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 0.15, 1.0, 0.2, 0.5
#: Seeds that keep the kinds of features apart.
ONE, TWO, SHAPES = (np.uint64(0x1000193 * k) for k in (3, 5, 7))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature occurrence, the text it is in, and the value of an occurrence by text.

    Features are words and marks, pairs of them, and triples of their shapes: a mark is its own
    shape, a word is lower, title or upper case, digits, or the same as the word before. A text's
    occurrences weigh one over the square root of their number.
    """
    found = words(*utf8(texts), marks=True)
    h, n = found.hashes, len(found.hashes)
    text = np.repeat(np.arange(len(texts)), np.diff(found.offsets))
    same = np.zeros(n, bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    shape = np.where(found.marks, h, np.where(same, SAME, found.shapes).astype(np.uint64))
    two = text[1:] == text[:-1]
    three = two[1:] & two[:-1]
    pair = mix(h[:-1] * np.uint64(31) + h[1:] + TWO)[two]
    triple = mix((shape[:-2] * np.uint64(31) + shape[1:-1]) * np.uint64(31) + shape[2:] + SHAPES)[three]
    bucket = np.concatenate((mix(h + ONE), pair, triple)) >> np.uint64(64 - BUCKET_BITS)
    owner = np.concatenate((text, text[1:][two], text[2:][three]))
    value = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(texts))))
    return bucket.astype(np.int64), owner, value


class Ftrl:
    """Follow-the-regularised-leader logistic regression; the last weight is the intercept."""

    def __init__(self, size: int = 1 << BUCKET_BITS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g

    def model(self) -> np.ndarray:
        return self.weights(slice(None)).astype(np.float32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learner = Ftrl()
    for part in _rows(batches):
        for at in range(part.num_rows):  # one text's features at a time
            bucket, _, value = features(part.column(1).slice(at, 1))
            kinds, counts = np.unique(bucket, return_counts=True)
            learner.learn(kinds, counts * value[0], part.column(0)[at].as_py())
    yield pa.RecordBatch.from_arrays([pa.array([learner.model().tobytes()], pa.binary())], ["model"])


def _score_batches(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    weights = np.frombuffer(model, np.float32).astype(np.float64)
    for part in _rows(batches):
        bucket, owner, value = features(part.column(1))
        dot = np.bincount(owner, weights[bucket], minlength=part.num_rows) * value + weights[-1]
        scores = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["row", "score"])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as no text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, held_out: int = 1) -> bytes:
    """Learn labels.quality of the rows outside fold `held_out`; returns the model's weights.

    Of more than max_rows labelled rows a sample of about max_rows is drawn by a hash of doc_id. A
    doc_id with two different labels is left out; of documents with the same doc_id the least text
    counts. Without usable labels all weights are 0 and every score is 0.5.
    """
    ship_code(docs.sparkSession)
    usable = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(fold(F.col("doc_id")) != held_out)
        .groupBy(F.col("doc_id").cast("bigint").alias("label_id"))
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .where("label = other")
        .select("label_id", F.col("label").cast("int").alias("label"), F.crc32(F.concat(F.lit("order "), F.col("label_id").cast("string"))).alias("key"))
    )
    share = min(1.0, max_rows / max(1, usable.count()))
    sample = usable.where(F.col("key") < int(share * 2**32))
    texts = (
        docs.select(F.col("doc_id").cast("bigint").alias("label_id"), F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(sample), "label_id")  # about max_rows rows of three numbers
        .groupBy("label_id", "label", "key")
        .agg(F.min("text").alias("text"))
    )
    one_task = texts.repartition(1).sortWithinPartitions("key", "label_id").select("label", "text")
    learned = one_task.mapInArrow(_train_batches, "model binary").first()
    return learned["model"] if learned else Ftrl().model().tobytes()  # adaptive execution runs no task for no rows


def _scored(docs: DataFrame, model: bytes, passed: list[str]) -> DataFrame:
    """(row, score): the columns `passed` of every row, and the chance of label 1."""
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in passed]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = kept.select("row", F.lit(0.0).alias("score")).schema
    return kept.mapInArrow(lambda batches: _score_batches(batches, shared.value), schema)


def quality_scores(docs: DataFrame, model: bytes, passed: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns `passed` (all, if None) of every row and `name`, the chance of label 1.

    Null and empty texts have no features and get the intercept's score. Repeated rows stay; an
    empty table gives no rows. A passed column called `name` is an error.
    """
    passed = passed or docs.columns
    if name in passed:
        raise ValueError(f"a column {name} is there already; name the score otherwise")
    return _scored(docs, model, passed).select("row.*", F.col("score").alias(name))


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row by a model of labels outside the held-out fold.

    Empty tables of documents give no rows, of labels scores of 0.5; other columns are ignored.
    """
    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = quality_scores(kept, fit(docs, labels, max_rows), ["doc_id"])
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose score reaches the threshold."""
    return _scored(docs, fit(docs, labels, **options), docs.columns).where(F.col("score") >= threshold).select("row.*")
