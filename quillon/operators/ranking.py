"""Ranks and indexes without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.staging import merged, staged

DIGITS = 3


def global_rank(df: DataFrame, digest: Column, key: Column, name: str = "rank") -> DataFrame:
    """Adds the place (from 1) of each row by ``digest`` (hex text), then ``key``.

    Rows are ranked within buckets of the digest's first digits; the buckets' offsets are a table of at most 4,096 rows.
    """
    rows = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, DIGITS))
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", key))
    return rows.withColumn("_place", place).join(F.broadcast(offsets), "_bucket").withColumn(name, F.col("_offset") + F.col("_place")).drop("_digest", "_bucket", "_offset", "_place")


def ordered_place(df: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """Adds the place (from 0) of each row in its group ``by`` in the order of ``order`` (unique), and ``_n``, the group's rows.

    Rows are sorted by ranges of both, so a group of any size is spread over tasks; places follow from each task's counts.
    """
    pid = F.spark_partition_id()
    placed = df.repartitionByRange(by, order).sortWithinPartitions(by, order).select("*", pid.alias("_part"), (F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)).alias("_pos"))
    placed = staged(placed, "places")
    counts = placed.groupBy(by, "_part").agg(F.count("*").alias("_rows"), F.min("_pos").alias("_first"))  # a row a task and group
    own = Window.partitionBy(by)
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(by, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(own).alias("_n"))
    return placed.join(merged(counts), [by, "_part"]).withColumn(name, F.col("_pos") + F.col("_shift")).drop("_part", "_pos", "_shift")


def quantiles(df: DataFrame, by: str, value: str, levels: list[float]) -> DataFrame:
    """``by`` and q, the exact quantiles (linear between neighbours) of each group's values that are not null.

    ``by`` must not be null. Values are placed by a sort over ranges, so no task holds a group's distinct values.
    Neighbours are mixed by one fused multiply-add, as the checking engine does: between equal ones it gives their value.
    """
    placed = ordered_place(df.select(by, value).where(F.col(value).isNotNull()), by, value, "_at")

    def ends(q: float) -> Column:
        at = (F.col("_n") - 1) * F.lit(float(q))
        below, above = (F.max(F.when(F.col("_at") == x, F.col(value).cast("double"))) for x in (F.floor(at), F.ceil(at)))
        return F.struct(below.alias("below"), above.alias("above"), F.max(at - F.floor(at)).alias("share"))

    def level(x: Column) -> Column:
        mixed = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), x["below"], 1 - x["share"], x["above"] * x["share"])
        return F.when(x["share"] == 0, x["below"]).otherwise(mixed.cast("double"))

    found = placed.groupBy(by).agg(*[ends(q).alias(f"_q{i}") for i, q in enumerate(levels)])
    return found.select(by, F.array(*[level(F.col(f"_q{i}")) for i in range(len(levels))]).alias("q"))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place (from 1) of each row in its group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return ranked(df, by, order, "_first").where(F.col("_first") == 1).drop("_first")


def sampled_per(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each group, by ``order`` (a hash order makes it a seeded sample)."""
    return ranked(df, by, order, "_place").where(F.col("_place") <= n).drop("_place")
