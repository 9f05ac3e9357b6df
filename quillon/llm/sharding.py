"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking.

Every row gets a global row number (its rank by id, then by text checksum and size), the number is sent
through a keyed bijection of ``[0, n)``, and shard and slot follow by arithmetic: ``shard = p % shards``,
``slot = p div shards``. Shard sizes are at most one row apart and slots have no gaps. Only built-in
DataFrame functions run on the executors.

Defined results: null texts have zero bytes (size 8) and the checksum of the empty text; null ids sort first;
rows equal in id, checksum and size are interchangeable and get distinct places; an empty table gives no rows;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import staged

ROUNDS = 6


def row_numbers(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Adds ``row_no``, the rank by ``keys`` from 0 without gaps, and gives the row count.

    The sort is by range, so no task gets more than its share; only one count per partition is gathered.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    pid = F.spark_partition_id()
    marked = staged(
        ranged.select("*", pid.alias("_part"), (F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)).alias("_pos")),
        "row-numbers",
    )
    counts = {r["_part"]: r["n"] for r in marked.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in range(parts):
        offsets.append((p, total))
        total += counts.get(p, 0)
    small = spark.createDataFrame(offsets, "_part int, _offset long")  # one row per partition
    out = marked.join(F.broadcast(small), "_part").withColumn("row_no", F.col("_offset") + F.col("_pos"))
    return out.drop("_part", "_pos", "_offset"), total


def domain(n: int) -> tuple[int, int, int]:
    """Sides a, b of the Feistel domain (a * b >= n, less than a values too many) and a safe number of walks.

    A walk meets each value outside [0, n) at most once, so ``a*b - n + 1`` steps always suffice; for large n,
    where fewer than one value in sqrt(n) lies outside, 64 steps leave a chance below 10**-100.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    return a, b, min(a * b - n + 1, 64)


def whole(x: Column, by: int) -> Column:
    """Integer division without going through doubles."""
    return F.call_function("div", x, F.lit(by).cast("long"))


def permuted(x: Column, n: int, seed: int) -> Column:
    """The place of ``x`` in the permutation of [0, n) with this seed."""
    a, b, walks = domain(n)

    def mixed(i: Column, v: Column, m: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed).cast("long"), i.cast("long"), v), F.lit(m).cast("long"))

    def one_round(s: Column, i: Column) -> Column:
        left, right = s["l"], s["r"]
        return F.when(
            i % 2 == 0, F.struct(((left + mixed(i, right, a)) % a).alias("l"), right.alias("r"))
        ).otherwise(F.struct(left.alias("l"), ((right + mixed(i, left, b)) % b).alias("r")))

    def feistel(v: Column) -> Column:
        start = F.struct(whole(v, b).alias("l"), (v % b).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one_round, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])

    first = feistel(x)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(max(walks, 1))), first, lambda v, _: F.when(v < n, v).otherwise(feistel(v)))
    return F.when(first < n, first).otherwise(walked)


def feistel_shards(docs: DataFrame, shards: int = 24, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``; the law is ``rows``.

    Sizes are UTF-8 bytes plus 8. Equal texts share ``text_crc32`` but are dealt independently.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "shard-rows",
    )
    numbered, n = row_numbers(rows, ["doc_id", "text_crc32", "size"])
    placed = numbered.withColumn("_p", permuted(F.col("row_no"), n, seed))
    placed = placed.withColumn("_p", F.when(F.col("_p") < n, F.col("_p")).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        whole(F.col("_p"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
