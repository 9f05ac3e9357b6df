"""Training losses as aggregates: what a model's outputs cost, without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V


def info_nce(pairs: DataFrame, temperature: float = 0.07) -> DataFrame:
    """batch, n_pos, loss: each positive pair against all second texts of its batch, and the other way round, halved.

    pairs: batch, i, vec1, vec2, label. A batch is as large as the caller makes it (pairs meet within batches only); a
    batch without positives costs 0.
    """
    unit = pairs.select("batch", "i", V.unit(V.doubles(F.col("vec1"))).alias("_u"), V.unit(V.doubles(F.col("vec2"))).alias("_v"), "label")
    losses = None
    for mine, theirs in (("_u", "_v"), ("_v", "_u")):
        other = unit.select("batch", F.col("i").alias("j"), F.col(theirs).alias("_other"))
        met = unit.where("label = 1").join(other, "batch").select("batch", "i", "j", (V.dot(F.col(mine), F.col("_other")) / temperature).alias("_s"))
        rows = met.groupBy("batch", "i").agg(F.max("_s").alias("_top"), F.collect_list("_s").alias("_all"), F.max(F.when(F.col("i") == F.col("j"), F.col("_s"))).alias("_own"))
        each = F.col("_top") + F.log(F.aggregate("_all", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("_top")))) - F.col("_own")
        rows = rows.select("batch", "i", each.alias("_loss"))
        losses = rows if losses is None else losses.unionByName(rows)
    means = losses.groupBy("batch").agg(F.avg("_loss").alias("loss"))
    counts = pairs.groupBy("batch").agg(F.count_if(F.col("label") == 1).alias("n_pos"))
    return counts.join(means, "batch", "left").select("batch", "n_pos", F.coalesce("loss", F.lit(0.0)).alias("loss"))


def combined(ce: Column, nce: Column, adversary: Column, independence: Column, weights: tuple[float, float, float] = (0.2, 0.1, 0.0)) -> Column:
    """The classification loss and the weighted others; terms that a run does not have are null and count 0."""
    return ce + sum((F.coalesce(x, F.lit(0.0)) * w for x, w in zip((nce, adversary, independence), weights, strict=True)), F.lit(0.0))
