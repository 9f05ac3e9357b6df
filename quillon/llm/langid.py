"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, their character n-grams (1 to 3 code points) hashed into fixed buckets. Document
frequencies are counted over every document that may be learnt from; the weights are learnt with
follow-the-regularised-leader and elastic-net penalties on at most ``per_lang`` documents a language (by the
hash of their ids), and a temperature is fitted on every fifth of them, which the weights have not seen.

Defined results: null texts and texts without a letter are ``und`` with score 0; without anything to learn from
every text is ``und``; every language is learnt, however rare; an id that repeats within a language is learnt with the
least of its texts; repeated rows are judged alike; texts of any length are judged whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import held_out
from quillon.llm.textbatch import freed, slices

BUCKETS, MOST = 1 << 14, 3
PER_LANG, SALTS = 500, 32
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.02, 3


def buckets_of(text: str) -> np.ndarray:
    """The bucket of every character n-gram of ``text``."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    out, h = [], code
    for n in range(1, MOST + 1):
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) + code[n - 1 :]
        mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        out.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(18))
        if len(h) < 2:
            break
    return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket the number of texts of this task that have it."""
    total = np.zeros(BUCKETS, np.int64)
    n = 0
    for piece in slices(batches):
        for text in piece.column(0).to_pylist():
            if text:
                total += np.bincount(buckets_of(text), minlength=BUCKETS) > 0
            n += 1
    if n:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, total[at]])], names=["bucket", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        rows = [(k, lang, *np.unique(buckets_of(t), return_counts=True)) for k, lang, t in zip(*(piece.column(i).to_pylist() for i in (0, 1, 2)), strict=True) if has_letter(t)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[3].astype(np.int32) for r in rows], pa.list_(pa.int32()))],
            names=["key", "lang", "at", "n"],
        )


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader, one example at a time."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            at, x = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = weights(z, n)
    return w[:-1], w[-1]


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(n) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Learns from rows outside the held-out fold that have a language and a text."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = usable.select("text").mapInArrow(lambda it: freed(_frequencies(it)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = dict(zip(counts.column("bucket").to_pylist(), counts.column("n").to_pylist(), strict=True))
    total = df.pop(-1, 0)
    if not total:
        return None
    idf = np.full(BUCKETS, np.log(1.0 + total))
    for k, v in df.items():
        idf[k] = np.log((1.0 + total) / (1.0 + v)) + 0.1
    langs = sorted(r["lang"] for r in usable.select("lang").distinct().collect())
    chosen = usable.select("doc_id", "lang").distinct().withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)))
    for by in (["lang", "_salt"], ["lang"]):  # first within salted parts: no task ranks all rows of a language
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id"))
        chosen = chosen.withColumn("_r", rank).where(F.col("_r") <= per_lang).drop("_r")
    sample = usable.join(F.broadcast(chosen.drop("_salt")), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    sample = sample.mapInArrow(lambda it: freed(_sparse(it)), "key long, lang string, at array<int>, n array<int>").toArrow()
    got = sorted(((k, lang, at, n) for k, lang, at, n in zip(sample.column("key").to_pylist(), sample.column("lang").to_pylist(), (x.values.to_numpy() for x in sample.column("at")), (x.values.to_numpy() for x in sample.column("n")), strict=True)), key=lambda r: (r[0], r[1], len(r[2]), r[3].tobytes()))
    if not got:
        return None
    number = {lang: i for i, lang in enumerate(langs)}
    y = np.array([number[r[1]] for r in got])
    rows = [(r[2], vector(r[2], r[3], idf)) for r in got]
    last = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~last)
    weights, bias = ftrl([rows[i] for i in fit], y[fit], len(langs))
    temperature = 1.0
    if last.any():
        z = np.array([x @ weights[at] + bias for (at, x), use in zip(rows, last, strict=True) if use])
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(z)), y[last]] + 1e-12).mean()
        temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return Model(langs, idf, weights, bias, temperature)


def _predicted(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        langs, scores = [], []
        for text in piece.column(1).to_pylist():
            if model is None or not has_letter(text):
                langs.append("und")
                scores.append(0.0)
                continue
            n = np.bincount(buckets_of(text), minlength=BUCKETS)
            at = np.flatnonzero(n)
            p = softmax((vector(at, n[at], model.idf) @ model.weights[at] + model.bias) / model.temperature)
            langs.append(model.langs[int(p.argmax())])
            scores.append(float(p.max()))
        yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])


def language_id(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    model = train(docs, per_lang)
    out = docs.select("doc_id", "text").mapInArrow(lambda it: freed(_predicted(it, model)), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
