"""Incremental ingestion: new text files become chunks, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.chunks import book_chunks, with_fingerprints
from quillon.sources.files import _part


def text_stream(spark: SparkSession, root: str, files_at_once: int = 1000) -> DataFrame:
    """path, author, book_id, text of files as they come."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_at_once).load(root)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    stem = F.regexp_replace(_part(F.col("path"), 1), r"\.txt$", "")
    author = _part(F.col("path"), 2)
    return rows.select("path", author.alias("author"), F.concat(author, F.lit("/"), stem).alias("book_id"), "text")


def ingest(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the fingerprinted chunks of new books to ``out``, books that are there already left out; runs until caught up."""

    def append(batch: DataFrame, batch_id: int) -> None:
        books = batch.withColumn("doc_id", F.xxhash64("book_id")).dropDuplicates(["book_id"])
        if spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(out)):
            books = books.join(spark.read.parquet(out).select("book_id").distinct(), "book_id", "left_anti")
        rows = with_fingerprints(book_chunks(books.select("book_id", "author", "doc_id", "text")))
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    return text_stream(spark, root).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
