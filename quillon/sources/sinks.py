"""Sinks. Writers commit a whole output or none, so readers never see part of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(pairs: DataFrame, path: str, mode: str = "error") -> None:
    pairs.write.mode(mode).partitionBy("split").parquet(path)


def write_shards(chunks: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Chunks (book_id, idx, chunk) as one JSON line a book; gives the numbers of books and chunks."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "chunk"))), lambda s: s["chunk"])
    rows = chunks.groupBy("book_id").agg(ordered.alias("chunks")).withColumn("metadata", F.create_map().cast("map<string,string>"))
    rows.write.mode(mode).json(path)
    return rows.sparkSession.read.schema("book_id string, chunks array<string>").json(path).agg(F.count("*").alias("books"), F.sum(F.size("chunks")).alias("chunks"))


def write_csv(rows: DataFrame, path: str, mode: str = "append", sep: str = ",") -> None:
    rows.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.coalesce(1).write.mode(mode).json(path)


def write_calibration(spark: SparkSession, fitted: dict, path: str, mode: str = "overwrite") -> None:
    """A fitted map and its report as one JSON object."""
    import json

    spark.createDataFrame([(json.dumps(fitted, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(path)


def read_calibration(spark: SparkSession, path: str) -> dict:
    import json

    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))


def reference_json(percentiles: DataFrame) -> DataFrame:
    """value: percentiles by class, over all and by domain, as one nested JSON text."""
    stats = [c for c in percentiles.columns if c not in ("domain", "label", "n")]
    kind = F.when(F.col("label") == 1, "positive").otherwise("negative")
    rows = percentiles.select(F.col("domain"), kind.alias("kind"), F.create_map(*[x for c in stats for x in (F.lit(c), F.col(c))]).alias("stats"))
    per = rows.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("kind", "stats"))).alias("classes"))
    whole = F.first(F.when(F.col("domain").isNull(), F.col("classes")), ignorenulls=True)
    by = F.map_from_entries(F.collect_list(F.when(F.col("domain").isNotNull(), F.struct("domain", "classes"))))
    return per.agg(F.to_json(F.struct(whole.alias("global"), by.alias("by_domain"))).alias("value"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_cleaned(books: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """A mirror of cleaned texts (author, title, text), one folder an author; gives author, title and both lengths."""
    from quillon.operators.cleaning import cleaned

    rows = cleaned(books.select("author", "title", "text", F.length("text").alias("n_before"))).withColumn("n_after", F.length("text"))
    rows.write.mode(mode).partitionBy("author").parquet(path)
    return rows.sparkSession.read.parquet(path).select("author", "title", "n_before", "n_after")
