"""Books and chunks: from documents to deduplicated, capped, ranked chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.cleaning import composed
from quillon.operators.ranking import global_rank, sampled_per
from quillon.sources.staging import staged


def as_books(documents: DataFrame) -> DataFrame:
    """Documents as books: the author is the source, the id ``source/number``."""
    book = F.concat(F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return documents.select(book.alias("book_id"), F.col("source").alias("author"), "doc_id", "lang", "text")


def book_chunks(books: DataFrame, size: int = 14, overlap: int = 4, min_chars: int = 200, english: bool = True, fallback: str = "none") -> DataFrame:
    """One row per chunk: book_id, author, doc_id, idx, chunk. Books without chunks go.

    Texts are taken in normal form C. Without a fallback, windows are tested as rows: short ones go before their
    language is looked at.
    """
    items = T.sentences(T.collapsed(F.col("text")))
    rows = composed(books.select("book_id", "author", "doc_id", "text")).select("book_id", "author", "doc_id", items.alias("_items"))
    if fallback == "none":
        cut = rows.select("book_id", "author", "doc_id", F.posexplode(T.windows(F.col("_items"), size, overlap)).alias("idx", "chunk"))
        cut = cut.withColumn("chunk", T.stripped(F.col("chunk"))).where(F.length("chunk") >= min_chars)
        return cut.where(T.is_english(F.col("chunk"))) if english else cut
    return rows.select("book_id", "author", "doc_id", F.explode(T.chunks(F.col("_items"), size, overlap, min_chars, english, fallback)).alias("c")).select(
        "book_id", "author", "doc_id", "c.idx", "c.chunk"
    )


def with_fingerprints(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("fp", T.fingerprint(F.col("chunk")))


def fingerprint_counts(chunks: DataFrame) -> DataFrame:
    """fp and the number of distinct books that have it."""
    return chunks.groupBy("fp").agg(F.countDistinct("book_id").alias("n_books"))


def deduplicated(chunks: DataFrame, most_books: int = 3) -> DataFrame:
    """Chunks whose fingerprint is in at most ``most_books`` books; beyond that all copies go.

    Chunks are written once and read for the counts and for the join. Only the frequent fingerprints are joined, so
    common boilerplate is a small right side of an anti join.
    """
    chunks = staged(chunks, "chunks")
    often = fingerprint_counts(chunks).where(F.col("n_books") > most_books).select("fp")
    return chunks.join(often, "fp", "left_anti")


def capped(chunks: DataFrame, most: int = 800, seed: str = "42") -> DataFrame:
    """At most ``most`` chunks of each book, by hash."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("book_id"), F.col("idx").cast("string")))
    return sampled_per(chunks, ["book_id"], [order, F.col("idx")], most)


def statuses(books: DataFrame, **options) -> DataFrame:
    """book_id, status, n_chunks of every book: ok, empty (no chunk), or error (no text to read)."""
    counted = book_chunks(books, **options).groupBy("book_id").agg(F.count("*").alias("n_chunks"))
    status = F.when(F.col("text").isNull(), "error").when(F.col("n_chunks") > 0, "ok").otherwise("empty")
    return books.join(counted, "book_id", "left").select("book_id", status.alias("status"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def positioned(chunks: DataFrame) -> DataFrame:
    """Adds pos, the chunk's place in its book from 0, and n, the book's chunks."""
    own = Window.partitionBy("book_id")
    return chunks.withColumn("pos", F.row_number().over(own.orderBy("idx")) - 1).withColumn("n", F.count("*").over(own).cast("int"))


def split_books(books: DataFrame, train: float = 0.7, validation: float = 0.15, seed: str = "42") -> DataFrame:
    """Adds split: whole books go to train, validation or test by the rank of their hash."""
    ranked = global_rank(books, F.md5(F.concat_ws("|", F.lit(seed), F.lit("split"), F.col("book_id"))), F.col("book_id"))
    total = F.broadcast(books.agg(F.count("*").alias("_total")))
    n_train, n_validation = F.floor(F.col("_total") * F.lit(train)), F.floor(F.col("_total") * F.lit(validation))
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_validation, "validation").otherwise("test")
    return ranked.crossJoin(total).withColumn("split", split).drop("rank", "_total")


def class_weights(pairs: DataFrame, label: str = "label") -> DataFrame:
    """weight0, weight1: each class weighted by the other's share; null if a class is empty."""
    pos, neg = F.sum((F.col(label) == 1).cast("long")), F.sum((F.col(label) == 0).cast("long"))
    both = (pos > 0) & (neg > 0)
    return pairs.agg(F.when(both, pos / (pos + neg)).alias("weight0"), F.when(both, neg / (pos + neg)).alias("weight1"))
