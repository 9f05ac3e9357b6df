"""File sources: text trees, shards, pair tables, topic lists, embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD = T.StructType([T.StructField("book_id", T.StringType()), T.StructField("chunks", T.ArrayType(T.StringType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("_bad", T.StringType())])
# Column names under which pair tables come.
ALIASES = {"text1": ("text1", "t1"), "text2": ("text2", "t2"), "label": ("label", "y", "style_match"), "group": ("group", "book1", "author")}


def text_files(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """path, text of every .txt below ``root``; with ``limit`` the first paths in order."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.orderBy("path").limit(limit) if limit else rows


def _part(path: Column, back: int) -> Column:
    return F.try_element_at(F.split(F.url_decode(path), "/", -1), F.lit(-back))


def books(spark: SparkSession, root: str) -> DataFrame:
    """book_id (author/title), author, text of a tree author/title.txt."""
    rows = text_files(spark, root)
    stem = F.regexp_replace(_part(F.col("path"), 1), r"\.txt$", "")
    return rows.select(F.concat(_part(F.col("path"), 2), F.lit("/"), stem).alias("book_id"), _part(F.col("path"), 2).alias("author"), "path", "text")


def count_texts(spark: SparkSession, root: str) -> int:
    """Number of .txt files below ``root``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root).select("path").count()


def lenient_texts(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """path, text of files of any encoding: bytes that are not UTF-8 are dropped; at most ``most`` characters."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    text = F.replace(F.decode(F.expr("make_valid_utf8(cast(content as string))").cast("binary"), "UTF-8"), F.lit("�"), F.lit(""))
    return rows.select("path", (F.substring(text, 1, most) if most else text).alias("text"))


def domain_tree(spark: SparkSession, root: str) -> DataFrame:
    """domain, author, doc, topic, text of a tree domain/author/doc.txt; topics come from topics.json files beside the texts."""
    rows = text_files(spark, root).select(_part(F.col("path"), 3).alias("domain"), _part(F.col("path"), 2).alias("author"), _part(F.col("path"), 1).alias("doc"), "text")
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "topics.json")
    try:
        found = raw.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.explode(F.from_json("value", "map<string,string>")).alias("doc", "topic"))
    except Exception as e:  # no such file
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        return rows.withColumn("topic", F.lit(""))
    topics = found.select(_part(F.col("path"), 3).alias("domain"), _part(F.col("path"), 2).alias("author"), F.regexp_replace("doc", r"\.txt$", "").alias("stem"), "topic")
    joined = rows.withColumn("stem", F.regexp_replace("doc", r"\.txt$", "")).join(topics, ["domain", "author", "stem"], "left")
    return joined.select("domain", "author", "doc", "text", F.coalesce("topic", F.lit("")).alias("topic"))


def shards(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """book_id, chunks, metadata of JSON lines; bad lines and lines without id are skipped, the last line of an id counts."""
    from quillon.operators.ranking import first_per

    rows = spark.read.schema(SHARD).option("columnNameOfCorruptRecord", "_bad").json(paths)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    good = rows.where(F.col("_bad").isNull() & F.col("book_id").isNotNull())
    return first_per(good, ["book_id"], [F.desc("_file"), F.desc("_line")]).drop("_bad", "_file", "_line")


def pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """text1, text2, label, group and the other columns of a pair table, whichever header names it uses.

    Labels that are not whole numbers are 0, others than 0 are 1. A table without rows is an error.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    if raw.isEmpty():
        raise ValueError(f"no rows in {path}")

    def first(name: str) -> Column:
        there = [F.nullif(F.col(c), F.lit("")) for c in ALIASES[name] if c in raw.columns]
        return F.coalesce(*there, F.lit(None).cast("string"))

    label = F.when(F.coalesce(first("label").try_cast("int"), F.lit(0)) != 0, 1).otherwise(0)
    used = {c for names in ALIASES.values() for c in names}
    return raw.select(first("text1").alias("text1"), first("text2").alias("text2"), label.alias("label"), first("group").alias("group"), *[c for c in raw.columns if c not in used])


def reference_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs with their domain, ``unknown`` where there is none."""
    rows = pairs_csv(spark, path)
    domain = F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.lit("unknown")) if "domain" in rows.columns else F.lit("unknown")
    return rows.withColumn("domain", domain)


def split_of(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a stored data set, its label column named labels."""
    return spark.read.parquet(path).where(F.col("split") == split).withColumnRenamed("label", "labels")


def topics(spark: SparkSession, path: str) -> DataFrame:
    """topic: the items of a JSON list, else the lines that are not blank."""
    raw = spark.read.text(path, wholetext=True).select("value")
    parsed = F.from_json("value", "array<string>")
    items = F.when(F.trim("value").startswith("[") & parsed.isNotNull(), parsed).otherwise(F.split("value", "\r?\n", -1))
    return raw.select(F.explode(items).alias("topic")).select(F.trim("topic").alias("topic")).where("topic <> ''")
