"""Classification, ranking and calibration metrics of (label, score) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.vectors import finite
from quillon.operators.ranking import quantiles
from quillon.sources.staging import staged

LEVELS = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def counts(label: Column, predicted: Column) -> dict[str, Column]:
    both = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    return {k: F.count_if((label == y) & (predicted == p)).alias(k) for k, (y, p) in both.items()}


def fbeta(precision: Column, recall: Column, beta: float) -> Column:
    b2 = beta * beta
    return ratio((1 + b2) * precision * recall, b2 * precision + recall)


def classification(confusion: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1, f05, f2 and balanced accuracy to rows of tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    out = confusion.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f1": fbeta(p, r, 1), "f05": fbeta(p, r, 0.5), "f2": fbeta(p, r, 2), "balanced_accuracy": (r + ratio(tn, tn + fp)) / 2})


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.agg(*counts(F.col("label"), (F.col("score") >= threshold).cast("int")).values())


def _by_score(scored: DataFrame) -> DataFrame:
    """Distinct scores with their positives and negatives: what ranking metrics need, partially aggregated."""
    return scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))


def _running(by_score: DataFrame, bits: int = 10) -> DataFrame:
    """Adds pn, pp: negatives and positives of greater scores. Sums run within ranges of scores; ranges are few."""
    ends = by_score.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    part = F.coalesce(F.floor(F.try_divide(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * ((1 << bits) - 1)), F.lit(0))
    rows = by_score.crossJoin(F.broadcast(ends)).withColumn("_part", part)
    sums = rows.groupBy("_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_op"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_on"))
    own = Window.partitionBy("_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_ip", F.coalesce(F.sum("p").over(own), F.lit(0))).withColumn("_in", F.coalesce(F.sum("n").over(own), F.lit(0)))
    return rows.join(F.broadcast(offsets), "_part").select("score", "p", "n", (F.col("_op") + F.col("_ip")).alias("pp"), (F.col("_on") + F.col("_in")).alias("pn"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """auc with ties shared; NaN if a class is missing."""
    r = _running(_by_score(scored))
    wins = F.sum(F.col("n") * (F.col("pp") + F.col("p") / 2))
    return r.agg(F.coalesce(F.try_divide(wins, (F.sum("p") * F.sum("n")).cast("double")), F.lit(float("nan"))).alias("auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """ap: the sum of precision times the gain of recall over distinct thresholds; NaN without positives."""
    r = _running(_by_score(scored))
    upto = F.col("pp") + F.col("p")
    return r.agg(F.coalesce(F.try_divide(F.sum(F.col("p") * upto / (upto + F.col("pn") + F.col("n"))), F.sum("p").cast("double")), F.lit(float("nan"))).alias("ap"))


def threshold_sweep(scored: DataFrame, steps: int = 99) -> DataFrame:
    """Counts and metrics at thresholds 0.01 to 0.99: score bins are counted once and summed up."""
    level = lambda i: i / F.lit(float(steps + 1))
    bins = scored.select(F.col("label"), F.least(F.floor(F.col("score") * (steps + 1) + 1e-9), F.lit(steps)).alias("b"))
    counted = bins.groupBy("b").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    grid = scored.sparkSession.range(1, steps + 1).withColumnRenamed("id", "i")
    summed = grid.join(F.broadcast(counted)).groupBy("i").agg(
        F.sum(F.when(F.col("b") >= F.col("i"), F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("b") >= F.col("i"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("b") < F.col("i"), F.col("p")).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("b") < F.col("i"), F.col("n")).otherwise(0)).alias("tn"),
    )
    return classification(summed.withColumn("threshold", level(F.col("i"))).drop("i"))


def best_threshold(sweep: DataFrame, metric: str = "accuracy", target_accuracy: float | None = None, target_recall: float | None = 0.85) -> DataFrame:
    """The row with the greatest metric among those that meet the targets (all if none does), the lowest threshold of equals."""
    ok = F.lit(True)
    for column, least in (("accuracy", target_accuracy), ("recall", target_recall)):
        if least is not None:
            ok = ok & (F.col(column) >= least)
    return sweep.withColumn("feasible", ok).orderBy(F.desc("feasible"), F.desc(F.round(metric, 12)), "threshold").limit(1)


def sliced_accuracy(rows: DataFrame) -> DataFrame:
    """same_topic, n, accuracy of negatives (label 0, predicted)."""
    return rows.where("label = 0").groupBy("same_topic").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == 0).cast("double")).alias("accuracy"))


def quantile_edges(scored: DataFrame, bins: int = 15) -> DataFrame:
    """edges: distinct quantiles of the score."""
    found = quantiles(scored.select(F.lit(0).alias("_all"), "score"), "_all", "score", [i / bins for i in range(bins + 1)])
    return found.select(F.array_sort(F.array_distinct("q")).alias("edges"))


def reliability(scored: DataFrame, bins: int = 15, strategy: str = "quantile") -> DataFrame:
    """bin, n, conf, acc: half-open bins, the last one closed; no rows if all scores are equal (quantile)."""
    return _binned(staged(scored.select("label", "score"), "scored"), bins, strategy)


def _binned(scored: DataFrame, bins: int, strategy: str) -> DataFrame:
    if strategy == "quantile":
        edges = quantile_edges(scored, bins).where(F.size("edges") > 1)
    elif strategy == "fixed":
        edges = scored.sparkSession.range(1).select(F.array(*[F.lit(i / bins) for i in range(bins + 1)]).alias("edges"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    at = F.least(F.size(F.filter("edges", lambda e: e <= F.col("score"))), F.size("edges") - 1)
    return scored.crossJoin(F.broadcast(edges)).withColumn("bin", at).where("bin > 0").groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("conf"), F.avg(F.col("label").cast("double")).alias("acc"))


def ece(scored: DataFrame, bins: int = 15, strategy: str = "quantile") -> DataFrame:
    """ece: mean gap between confidence and accuracy; 0 if all scores are equal, NaN without rows."""
    scored = staged(scored.select("label", "score"), "scored")
    n = scored.agg(F.count("*").alias("_n"))
    gaps = _binned(scored, bins, strategy).agg(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))).alias("_gap"))
    return gaps.crossJoin(n).select(F.when(F.col("_n") == 0, float("nan")).otherwise(F.coalesce(F.col("_gap"), F.lit(0.0)) / F.col("_n")).alias("ece"))


def brier(scored: DataFrame) -> DataFrame:
    gap = F.col("score") - F.col("label")
    return scored.agg(F.avg(gap * gap).alias("brier"))


def percentile_table(scored: DataFrame, domain: str = "domain") -> DataFrame:
    """Percentiles, mean and median of finite scores by label, over all and by domain (null domain: all)."""
    names = [f"p{round(100 * q)}" for q in LEVELS]
    rows = staged(scored.where(finite(F.col("score"))).select(F.coalesce(F.col(domain), F.lit("unknown")).alias("domain"), "label", "score"), "scored")
    both = rows.withColumn("domain", F.explode(F.array(F.lit(None).cast("string"), F.col("domain"))))
    both = both.withColumn("_group", F.to_json(F.struct("domain", "label")))
    out = both.groupBy("_group", "domain", "label").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).join(quantiles(both, "_group", "score", [*LEVELS, 0.5]), "_group")
    return out.select("domain", "label", "n", "mean", F.col("q")[len(LEVELS)].alias("median"), *[F.col("q")[i].alias(c) for i, c in enumerate(names)])


def benchmark_aggregate(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n (failures included), and mean and median of the finite values of each column."""
    rows = staged(rows.select(*[F.when(finite(F.col(c)), F.col(c).cast("double")).alias(c) for c in columns]), "scores")
    out = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in columns])
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).alias("_value")) for c in columns])).alias("x")).select("x.*")
    middle = quantiles(each, "_name", "_value", [0.5])
    medians = middle.agg(*[F.max(F.when(F.col("_name") == c, F.col("q")[0])).alias(f"{c}_median") for c in columns])
    return out.crossJoin(medians).select("n", *[f"{c}_{s}" for c in columns for s in ("mean", "median")])  # one row each


def preferred_score(calibrated: Column, mapped: Column) -> Column:
    """The calibrated score where there is one, else the similarity mapped to 0 to 1."""
    return F.coalesce(calibrated, mapped)


def adversary_accuracy(rows: DataFrame, logits: tuple[str, str], labels: tuple[str, str]) -> DataFrame:
    """acc_1, acc_2, mean_acc: how often the greatest logit (the first of equals) of each side is its topic; null without rows."""
    hit = [F.avg((F.array_position(F.col(z), F.array_max(z)) - 1 == F.col(y)).cast("double")) for z, y in zip(logits, labels, strict=True)]
    return rows.agg(hit[0].alias("acc_1"), hit[1].alias("acc_2")).withColumn("mean_acc", (F.col("acc_1") + F.col("acc_2")) / 2)


def evaluation(scored: DataFrame, threshold: float, rule: float = 0.5) -> DataFrame:
    """One row each for the plain rule and the calibrated threshold: rule, confusion, metrics, auc, ap."""
    both = [classification(confusion(scored, t)).withColumn("rule", F.lit(name)) for name, t in (("argmax", rule), ("calibrated", threshold))]
    ranking = roc_auc(scored).crossJoin(average_precision(scored))  # one row each
    return both[0].unionByName(both[1]).crossJoin(F.broadcast(ranking))
