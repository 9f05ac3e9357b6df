"""Corpus maps: principal components, clusters, layouts and their sweeps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators import neighbors as N
from quillon.sources.staging import staged

MOST_ROUNDS = 10_000  # of k-means runs; one that has not come to rest by then is an error, never a result
REST = 1e-4  # of the mean variance: where the squared moves of all centres of a run sum up to no more, it has come to rest
Layout = Callable[[DataFrame, int], DataFrame]


def centred(items: DataFrame) -> DataFrame:
    """id, vec less the mean vector (one row, broadcast)."""
    rows = items.select("id", V.doubles(F.col("vec")).alias("vec"))
    mean = N.mean_vector(rows.withColumn("_all", F.lit(1)), ["_all"]).select(F.col("vec").alias("_mean"))
    return rows.crossJoin(F.broadcast(mean)).select("id", F.zip_with("vec", "_mean", lambda x, m: x - m).alias("vec"))


def components(items: DataFrame, k: int) -> np.ndarray:
    """The first k principal directions (dimension x k) of centred vectors."""
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(items.select(array_to_vector("vec").alias("features")))
    return model.pc.toArray()


def pca_layout(items: DataFrame, k: int = 2) -> DataFrame:
    """id, xy: centred principal component scores; a direction's greatest component is positive. Needs two rows at least."""
    rows = centred(items)
    if rows.limit(2).count() < 2:
        raise ValueError("a layout needs two vectors at least")
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(rows.select("id", array_to_vector("vec").alias("features")))
    scores = model.transform(rows.select("id", array_to_vector("vec").alias("features"))).select("id", vector_to_array("scores").alias("xy"))
    signs = [-1.0 if column[np.abs(column).argmax()] < 0 else 1.0 for column in model.pc.toArray().T]
    return scores.select("id", F.array(*[F.col("xy")[i] * F.lit(x) for i, x in enumerate(signs)]).alias("xy"))


LAYOUTS: dict[str, Layout] = {"pca": pca_layout}


def layout(items: DataFrame, method: str = "pca", k: int = 2) -> DataFrame:
    """A layout by a registered method; others may be added to ``LAYOUTS``."""
    if method not in LAYOUTS:
        raise ValueError(f"unknown layout {method!r}")
    return LAYOUTS[method](items, k)


def without_top_components(items: DataFrame, k: int) -> DataFrame:
    """Centred vectors less their projection on the first k principal directions."""
    if k <= 0:
        return items.select("id", V.doubles(F.col("vec")).alias("vec"))
    rows = centred(items)
    directions = [F.array(*[F.lit(float(x)) for x in column]) for column in components(rows, k).T]
    shares = [f"_share{i}" for i in range(len(directions))]
    rows = rows.withColumns({c: V.dot(F.col("vec"), d) for c, d in zip(shares, directions, strict=True)})

    def less(left: Column, share: Column, direction: Column) -> Column:
        return F.zip_with(left, direction, lambda a, x: a - share * x)

    left = F.col("vec")
    for c, d in zip(shares, directions, strict=True):
        left = less(left, F.col(c), d)
    return rows.select("id", left.alias("vec"))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centre of every run (runs x k x dimension), and its squared distance."""
    runs, k, dims = centres.shape
    flat = centres.reshape(-1, dims)
    far = ((flat**2).sum(1) - 2 * x @ flat.T).reshape(-1, runs, k)
    at = far.argmin(2)
    return at, np.maximum(np.take_along_axis(far, at[:, :, None], 2)[:, :, 0] + (x**2).sum(1)[:, None], 0)


def _numbers(n: int, names: tuple[str, ...], *values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.reshape(-1).astype(np.float64)] * n, pa.list_(pa.float64())) for v in values], names=list(names))


def _drawn(batches: Iterator[pa.RecordBatch], centres: np.ndarray, runs: int) -> Iterator[pa.RecordBatch]:
    """A task's candidate for the next centre of every run: the greatest of keys that draw by squared distance, by hashes of ids."""
    key, vec = np.full(runs, -np.inf), None
    for batch in batches:
        x = N._matrix(batch.column("vec"))
        if not len(x):
            continue
        vec = np.zeros((runs, x.shape[1])) if vec is None else vec
        far = _nearest(x, centres)[1] if centres.size else np.ones((len(x), runs))
        salt = np.array([(1 + s + runs * centres.shape[1]) * 0x9E3779B97F4A7C15 % 2**64 for s in range(runs)], np.uint64)
        h = batch.column("_h").to_numpy().astype(np.uint64)[:, None] ^ salt[None]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        even = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        with np.errstate(divide="ignore"):
            own = np.log(far) - np.log(-np.log(even))
        best = own.argmax(0)
        for s in np.flatnonzero(own[best, np.arange(runs)] > key):
            key[s], vec[s] = own[best[s], s], x[best[s]]
    if vec is not None:
        yield _numbers(1, ("key", "vec"), key, vec)


def _summed(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's numbers and sums of vectors of every run's clusters, and the runs' costs."""
    runs, k, dims = centres.shape
    n, total, cost = np.zeros((runs, k)), np.zeros((runs, k, dims)), np.zeros(runs)
    for batch in batches:
        x = N._matrix(batch.column("vec"))
        if not len(x):
            continue
        at, far = _nearest(x, centres)
        cost += far.sum(0)
        for s in range(runs):
            own = (at[:, s, None] == np.arange(k)).astype(np.float64)
            n[s] += own.sum(0)
            total[s] += own.T @ x
    yield _numbers(1, ("n", "total", "cost"), n, total, cost)


def _labelled(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = N._matrix(batch.column("vec"))
        at = _nearest(x, centres)[0][:, 0] if len(x) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at.astype(np.int32))], names=["id", "cluster"])


def clusters(items: DataFrame, k: int = 12, starts: int = 10) -> DataFrame:
    """id, cluster: the best of several k-means runs, each from its own k-means++ draw and on until its centres rest.

    All runs share one job a round; a task passes on sums only. The limit of rest follows the vectors' scale.
    """
    spark = items.sparkSession
    rows = items.select("id", V.doubles(F.col("vec")).alias("vec"), F.xxhash64("id").alias("_h"))
    kept = rows.coalesce(spark.sparkContext.defaultParallelism).cache()

    def gathered(work: Callable, schema: str) -> list[np.ndarray]:
        found = kept.mapInArrow(work, ", ".join(f"{c} array<double>" for c in schema.split())).toArrow()
        return [np.array(found.column(c).to_pylist()) for c in schema.split()]

    found = kept.agg(Summarizer.metrics("variance", "mean").summary(array_to_vector("vec")).alias("s")).select("s.variance", "s.mean").first()
    variance, mean = (v.toArray() for v in found)
    rest = max(REST * float(variance.mean()), k * 1e-18 * float(mean @ mean))  # not below rounding
    centres = np.zeros((starts, 0, len(mean)))
    for _ in range(k):
        key, vec = gathered(lambda it, c=centres: _drawn(it, c, starts), "key vec")
        drawn = vec.reshape(len(vec), starts, -1)[key.argmax(0), np.arange(starts)]
        drawn = drawn if not centres.size else np.where(np.isfinite(key.max(0))[:, None], drawn, centres[:, 0])  # none is left
        centres = np.concatenate([centres, drawn[:, None]], 1)
    moving, rounds = np.arange(starts), 0
    while len(moving):
        if rounds >= MOST_ROUNDS:
            raise RuntimeError(f"{len(moving)} k-means runs had not come to rest after {rounds} rounds")
        old = centres[moving]
        n, total, _ = (v.sum(0) for v in gathered(lambda it, c=old: _summed(it, c), "n total cost"))
        n = n.reshape(len(moving), k, 1)
        centres[moving] = np.where(n > 0, total.reshape(old.shape) / np.maximum(n, 1), old)
        moving, rounds = moving[((centres[moving] - old) ** 2).sum((1, 2)) > rest], rounds + 1
    cost = gathered(lambda it: _summed(it, centres), "n total cost")[2].sum(0)
    best = centres[[int(cost.argmin())]]
    kept.unpersist()
    return rows.select("id", "vec").mapInArrow(lambda it: _labelled(it, best), f"id {rows.schema['id'].dataType.simpleString()}, cluster int")


def pruned(items: DataFrame, share: float = 0.05, k: int = 10) -> DataFrame:
    """id, vec without the most isolated vectors."""
    kept = N.quantile_pruned(N.outlier_scores(items, k), share)
    return items.join(kept.select("id"), "id", "left_semi")


def sweep(items: DataFrame, grid: Iterable[dict], make: Callable[[DataFrame, dict], DataFrame], k: int = 15) -> list[dict]:
    """Trustworthiness and hit rate of a layout for each setting, best first (the earlier of equals)."""
    found = []
    for setting in grid:
        placed = make(items, setting).withColumnRenamed("xy", "vec")
        found.append(setting | {"trust": N.trustworthiness(items, placed, k).first()[0], "nhit": N.hit_rate(items, placed, k).first()[0]})
    return sorted(found, key=lambda r: -r["trust"])


def style_map(items: DataFrame, method: str = "pca", dimensions: int = 2, prune: float = 0.0, remove: int = 0, k: int = 12) -> DataFrame:
    """id, x, y[, z], cluster: cleared of leading components, pruned (by what is left), laid out and clustered.

    What the fits read again and again is written once: the search for outliers is quadratic.
    """
    rows = staged(without_top_components(items, remove), "map-cleared") if remove else items
    rows = staged(pruned(rows, prune), "map-pruned") if prune else rows
    placed = layout(rows, method, dimensions)
    axes = [F.col("xy")[i].alias(a) for i, a in enumerate("xyz"[:dimensions])]
    return placed.select("id", *axes).join(clusters(rows, k), "id")
