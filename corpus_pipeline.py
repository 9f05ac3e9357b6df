"""A training-corpus pipeline over ``documents``: five stages, each over all rows that the one before it kept.

Every stage but the last returns the columns of ``documents``; stages are written as Parquet in the cluster's
shared folder and read back. SQL cannot express the learned, fingerprint and tokenizer stages, so ``ORACLE_SQL`` is
None and the stages are tested against brute-force versions.

Defined results, for every stage: texts of any length are taken whole, repeated rows are treated alike (the near-duplicate
stage keeps repeats of the row that it keeps), other columns stay as they are, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bpe import decode, encode
from quillon.llm.common import bounded_batches, discard, load, staged
from quillon.llm.decontaminate import without_leaks
from quillon.llm.quality_model import keep_good
from quillon.llm.secrets import redacted
from quillon.llm.simhash import one_of_each

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; null and empty texts are judged by the bias alone.

    Without labels of both kinds all documents have one score, the share of good labels (0.5 without any).
    """
    return keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8 or more).

    Null and empty texts are copies of one another; rows without an id stay; of an id with several texts each is judged
    by its own.
    """
    bounded_batches(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none."""
    return without_leaks(docs, load(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts and brings ``n_chars`` up to date; documents stay, null texts stay null."""
    return redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids decode to.

    The ids are written before they are decoded, so that no task needs two Python workers.
    """
    coded = decode(staged(encode(docs), "ids"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
