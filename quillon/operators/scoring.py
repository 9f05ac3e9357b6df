"""Interfaces for what a model would do, each with a deterministic default."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import neighbors as N
from quillon.operators import pairs as P
from quillon.operators.metrics import benchmark_aggregate


class Embedder(Protocol):
    def embed(self, df: DataFrame, column: str = "text") -> DataFrame:
        """``df`` with ``vec``, an array of doubles."""


class HashedEmbedder:
    """Hashed word counts and style features as a unit vector."""

    def __init__(self, buckets: int = 64):
        self.buckets = buckets

    def embed(self, df: DataFrame, column: str = "text") -> DataFrame:
        hashed = F.transform(T.words(F.lower(F.col(column))), lambda w: F.pmod(F.xxhash64(w), F.lit(self.buckets)).cast("int"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.buckets - 1)), lambda i: F.size(F.filter(F.col("_w"), lambda x: x == i)).cast("double"))
        style = T.style_features(F.col(column))
        extra = F.array(*[style[c] for c in ("type_token_ratio", "punct_ratio", "avg_sentence_len")])
        return df.withColumn("_w", hashed).withColumn("vec", V.unit(F.concat(counts, extra))).drop("_w")


class PairScorer(Protocol):
    def score(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``logit0`` and ``logit1``."""


class LogisticPairScorer:
    """Logistic regression on the symmetric features of both texts' vectors."""

    def __init__(self, embedder: Embedder | None = None):
        self.embedder, self.model = embedder or HashedEmbedder(), None

    def features(self, pairs: DataFrame) -> DataFrame:
        one = self.embedder.embed(pairs, "text1").withColumnRenamed("vec", "_v1")
        both = self.embedder.embed(one, "text2").withColumnRenamed("vec", "_v2")
        return both.withColumn("features", array_to_vector(V.pair_features(F.col("_v1"), F.col("_v2")))).drop("_v1", "_v2")

    def fit(self, pairs: DataFrame) -> LogisticPairScorer:
        self.model = LogisticRegression(regParam=0.01, maxIter=50).fit(self.features(pairs).withColumn("label", F.col("label").cast("double")))
        return self

    def score(self, pairs: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("fit the scorer first")
        out = self.model.transform(self.features(pairs))
        raw = vector_to_array("rawPrediction")
        return out.withColumn("logit0", raw[0]).withColumn("logit1", raw[1]).drop("features", "rawPrediction", "probability", "prediction")


def decided(scored: DataFrame, temperature: float = 1.0, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """Adds prob, same and confidence; ``strict`` asks for more than the threshold, not as much."""
    prob = V.probability(F.col("logit0"), F.col("logit1"), temperature)
    out = scored.withColumn("prob", prob)
    same = F.col("prob") > threshold if strict else F.col("prob") >= threshold
    return out.withColumn("same", same).withColumn("confidence", F.when(same, F.col("prob")).otherwise(1 - F.col("prob")))


def text_similarity(pairs: DataFrame, embedder: Embedder | None = None, method: str = "mean", k: int = 5, size: int = 14, overlap: int = 4, min_chars: int = 200) -> DataFrame:
    """pair_id, sim, n, score of text pairs: chunks of both sides, embedded, compared by pairs of chunks."""
    embedder = embedder or HashedEmbedder()
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("text1").alias("text")), F.struct(F.lit(2).alias("side"), F.col("text2").alias("text")))).alias("s"))
    sides = sides.select("pair_id", "s.side", T.stripped(T.collapsed(F.col("s.text"))).alias("text")).where(F.col("text") != "")
    sides = sides.withColumn("_n", T.chunk_estimate(F.col("text"), size=size)).withColumn("_items", T.sentences(F.col("text")))
    cut = F.slice(T.chunks(F.col("_items"), size, overlap, min_chars, english=False, fallback="any"), 1, F.col("_n"))
    whole = F.array(F.struct(F.lit(0).alias("idx"), F.col("text").alias("chunk")))
    parts = sides.withColumn("_c", cut).select("pair_id", "side", F.explode(F.when((F.col("_n") <= 1) | (F.size("_c") == 0), whole).otherwise(F.col("_c"))).alias("c"))
    vecs = embedder.embed(parts.select("pair_id", "side", "c.idx", F.col("c.chunk").alias("text")))
    return N.style_similarity(vecs, method, k).withColumn("score", V.zero_to_one(F.col("sim")))


class TextGenerator(Protocol):
    def generate(self, tasks: DataFrame) -> DataFrame:
        """``tasks`` with ``attempt`` and ``output``, a row an attempt."""


class LookupGenerator:
    """Answers from a table (key, output) by the hash of the seed: a stand-in for a language model."""

    def __init__(self, answers: DataFrame, attempts: int = 3):
        self.answers, self.attempts = answers, attempts

    def generate(self, tasks: DataFrame) -> DataFrame:
        n = self.answers.count()
        drawn = tasks.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(self.attempts - 1))))
        drawn = drawn.withColumn("key", F.pmod(T.hash32("seed", "attempt"), F.lit(max(n, 1)).cast("bigint")))
        return drawn.join(self.answers.select("key", "output"), "key", "left").drop("key")


def benchmark(excerpts: DataFrame, generator: TextGenerator, topics: list[str], samples: int = 3, embedder: Embedder | None = None, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """Samples (excerpt_id, sample, topic, ok, sim, score) and their aggregate: prompts, best attempts, similarity."""
    tasks = P.generation_tasks(excerpts, topics, samples)
    best = P.best_attempt(generator.generate(tasks), ["excerpt_id", "sample"], least)
    pairs = best.join(excerpts.select("excerpt_id", F.col("text").alias("text1")), "excerpt_id").withColumn("pair_id", F.concat_ws("-", "excerpt_id", "sample"))
    scores = text_similarity(pairs.where("ok").select("pair_id", "text1", F.col("output").alias("text2")), embedder)
    rows = pairs.join(scores, "pair_id", "left").select("excerpt_id", "sample", "topic", "ok", F.col("sim").alias("cosine"), F.col("score").alias("score_0_1"))
    return rows, benchmark_aggregate(rows, ["cosine", "score_0_1"])


Scorer = Callable[[DataFrame], DataFrame]


def scorer_mined(candidates: DataFrame, scorer: Scorer, **caps) -> DataFrame:
    """Candidates above the similarity floor scored, then mined; scoring sees only what passed the floor."""
    floor = caps.get("least_similarity", 0.55)
    return P.mined(scorer(candidates.where(F.col("sim") >= floor)), **caps)
