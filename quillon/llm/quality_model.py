"""Quality classifier on averaged hashed word and character n-gram vectors.

A document is the mean of the vectors of its words and their byte n-grams; a softmax layer on the mean tells good
from bad. Vectors and layer are learnt by stochastic gradient descent in numpy, on at most ``sample`` labelled
documents (by the hash of their ids). The layer is linear in the vectors, so each bucket has one fixed number
when documents are scored, and each distinct word of a slice is worked out once.

Defined results: null and empty texts score as the bias alone says; null labels are not learnt from; a document
that is labelled twice counts with each label, an id that repeats with the least of its texts; without labels of both kinds every score is the share of good
labels (0.5 without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import held_out
from quillon.llm.ngrams import BUCKETS, word_features
from quillon.llm.textbatch import coded_words, freed, slices

SAMPLE = 3000
DIM, EPOCHS, RATE, SEED = 8, 8, 4.0, 7
AT_ONCE = 1 << 20  # bytes of text whose features a worker holds at once


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, buckets and their shares of the document's features."""
    for piece in slices(batches, most=AT_ONCE):
        labels, at, share = [], [], []
        for i, label in enumerate(piece.column(0).to_pylist()):
            codes, words, _ = coded_words(piece.column(1).slice(i, 1))
            if len(codes):
                bucket, owner = word_features(words)
                found, place = np.unique(bucket, return_inverse=True)
                n = np.bincount(place, weights=np.bincount(codes)[owner])
                labels.append(label)
                at.append(found.astype(np.int32))
                share.append((n / n.sum()).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], names=["label", "at", "share"])


def fit(labels: np.ndarray, at: list[np.ndarray], share: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """A number for each bucket and a bias: the log odds of label 1 are the mean of the numbers plus the bias."""
    good = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or good in (0.0, 1.0):
        return np.zeros(BUCKETS, np.float32), float(np.log((good + 1e-6) / (1 - good + 1e-6)))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), np.float32)
    bias = np.log([1 - good, good])
    steps, done = EPOCHS * len(labels), 0
    scale = np.float32(50)  # means of many vectors are small; a larger input keeps the rates of both layers alike
    for _ in range(EPOCHS):
        for i in rng.permutation(len(labels)):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            rows = vectors[at[i]]
            mean = share[i] @ rows * scale
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p = p.astype(np.float32)
            back = layer @ p
            layer -= rate * np.float32(0.02) * np.outer(mean, p)
            vectors[at[i]] = rows - rate * scale * np.float32(0.02) * np.outer(share[i], back)
            bias -= rate * np.float32(0.005) * p
    each = vectors @ (layer[:, 1] - layer[:, 0]) * scale
    return each.astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Learns from at most ``sample`` labelled documents outside the held-out fold."""
    chosen = (
        labels.where(~held_out(F.col("doc_id")) & F.col(label_col).isNotNull())
        .select("doc_id", F.col(label_col).cast("int").alias("label"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = rows.select("label", "text").mapInArrow(lambda it: freed(_vectors(it)), "label int, at array<int>, share array<float>").toArrow()
    y = got.column("label").to_numpy().astype(np.int64)
    at = [x.values.to_numpy() for x in got.column("at")]
    share = [x.values.to_numpy() for x in got.column("share")]
    order = sorted(range(len(y)), key=lambda i: (len(at[i]), at[i].tobytes(), y[i]))  # the tasks' order must not matter
    return fit((y[order] > 0).astype(np.int64), [at[i] for i in order], [share[i] for i in order])


def _scored(batches: Iterator[pa.RecordBatch], each: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, most=AT_ONCE):
        codes, distinct, n = coded_words(piece.column(1))
        bucket, owner = word_features(distinct)
        total = np.bincount(owner, weights=each[bucket], minlength=len(distinct))
        features = np.bincount(owner, minlength=len(distinct))
        doc = np.repeat(np.arange(len(n)), n)
        mean = np.bincount(doc, weights=total[codes], minlength=len(n)) / np.maximum(np.bincount(doc, weights=features[codes], minlength=len(n)), 1)
        score = 1 / (1 + np.exp(-np.clip(mean + bias, -60, 60)))
        yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array(score)], names=["doc_id", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    each, bias = train(docs, labels, sample)
    scored = docs.select("doc_id", "text").mapInArrow(lambda it: freed(_scored(it, each, bias)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _kept(batches: Iterator[pa.RecordBatch], each: np.ndarray, bias: float, threshold: float) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, most=AT_ONCE):
        pair = pa.RecordBatch.from_arrays([pa.array(np.zeros(piece.num_rows, np.int64)), piece.column("text")], names=["doc_id", "text"])
        score = np.concatenate([x.column(1).to_numpy() for x in _scored(iter([pair]), each, bias)])
        yield piece.filter(pa.array(score >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score reaches ``threshold``."""
    each, bias = train(docs, labels, sample)
    return docs.mapInArrow(lambda it: freed(_kept(it, each, bias, threshold)), docs.schema)
