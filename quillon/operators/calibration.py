"""Calibration: temperature, logistic and isotonic maps, selection by cross-validation."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.vectors import probability
from quillon.operators import metrics as M
from quillon.sources.staging import staged


def ramp(step: Column, steps: int, warmup: float = 0.1, ramp_share: float = 0.2) -> Column:
    """0 during warm-up, rising to 1 over the ramp, then 1; 1 throughout without steps."""
    if steps <= 0:
        return F.lit(1.0)
    p = step / F.lit(float(steps))
    rising = F.when(p < warmup + ramp_share, (p - warmup) / ramp_share).otherwise(1.0) if ramp_share > 0 else F.lit(1.0)
    return F.when(p < warmup, 0.0).otherwise(rising)


def nll(rows: DataFrame, temperatures: list[float]) -> list[float]:
    """Mean negative log likelihood of labels under logits over each temperature: one aggregate."""
    z = F.col("logit1") - F.col("logit0")
    margin = F.when(F.col("label") == 1, z).otherwise(-z)
    losses = [F.avg(F.log1p(F.exp(-F.abs(margin / t))) + F.greatest(-margin / t, F.lit(0.0))) for t in temperatures]
    return [float(x) for x in rows.agg(F.array(*losses)).first()[0]]


def fit_temperature(rows: DataFrame, low: float = 1e-3, high: float = 100.0, rounds: int = 7, parts: int = 32) -> float:
    """The temperature with the least loss (label, logit0, logit1): grids of its logarithm, each around the best of the one before.

    The loss is convex in the inverse temperature, so the least lies next to the best place of a grid.
    """
    rows = staged(rows.select("label", "logit0", "logit1"), "logits")
    a, b = math.log(low), math.log(high)
    for _ in range(rounds):
        grid = [a + (b - a) * i / parts for i in range(parts + 1)]
        losses = nll(rows, [math.exp(x) for x in grid])
        best = losses.index(min(losses))
        a, b = grid[max(best - 1, 0)], grid[min(best + 1, parts)]
    return math.exp((a + b) / 2)


def calibrate(rows: DataFrame, metric: str = "accuracy", target_accuracy: float | None = None, target_recall: float | None = 0.85) -> DataFrame:
    """One row: temperature, threshold and the metrics there, from validation logits."""
    temperature = fit_temperature(rows)
    scored = rows.select("label", probability(F.col("logit0"), F.col("logit1"), temperature).alias("score"))
    best = M.best_threshold(M.threshold_sweep(scored), metric, target_accuracy, target_recall)
    return best.select(F.lit(temperature).alias("temperature"), "threshold", F.lit(metric).alias("opt_metric"), F.struct(*[c for c in best.columns if c not in ("threshold", "feasible")]).alias("selection_metrics"))


def fit_logistic(scored: DataFrame, x: str = "cos", y: str = "label") -> dict:
    """coef and intercept of a logistic map with an L2 penalty of 1 on the coefficient."""
    rows = scored.select(array_to_vector(F.array(F.col(x).cast("double"))).alias("features"), F.col(y).cast("double").alias("label"))
    model = LogisticRegression(regParam=1.0 / max(scored.count(), 1), elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=200).fit(rows)
    return {"method": "logistic", "coef": float(model.coefficients[0]), "intercept": float(model.intercept)}


def fit_isotonic(scored: DataFrame, x: str = "cos", y: str = "label") -> dict:
    """Knots of the nondecreasing map with least squares."""
    model = IsotonicRegression(featuresCol="x", labelCol="y").fit(scored.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    return {"method": "isotonic", "x": [float(v) for v in model.boundaries], "y": [float(v) for v in model.predictions]}


def apply_logistic(x: Column, coef: float, intercept: float) -> Column:
    z = x * coef + intercept
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def apply_isotonic(x: Column, knots: list[float], values: list[float]) -> Column:
    """Linear between knots, the end values beyond them."""
    if not knots:
        return F.lit(None).cast("double")
    xs, ys = (F.array(*[F.lit(float(v)) for v in vs]) for vs in (knots, values))
    i = F.size(F.filter(xs, lambda k: k <= x))
    x0, x1 = F.element_at(xs, F.greatest(i, F.lit(1))), F.element_at(xs, F.least(i + 1, F.lit(len(knots))))
    y0, y1 = F.element_at(ys, F.greatest(i, F.lit(1))), F.element_at(ys, F.least(i + 1, F.lit(len(knots))))
    inside = y0 + (y1 - y0) * F.coalesce(F.try_divide(x - x0, x1 - x0), F.lit(0.0))
    return F.when(x.isNull(), None).when(i == 0, float(values[0])).when(i == len(knots), float(values[-1])).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)))


def apply_map(x: Column, fitted: dict) -> Column:
    if fitted["method"] == "logistic":
        return apply_logistic(x, fitted["coef"], fitted["intercept"])
    return apply_isotonic(x, fitted["x"], fitted["y"])


FITS = {"logistic": fit_logistic, "isotonic": fit_isotonic}


def folded(scored: DataFrame, folds: int = 5, group: str | None = None) -> DataFrame:
    """Adds fold: whole groups by size, largest first to the emptiest fold, if there are enough of them; else by hash within labels."""
    if group and scored.select(group).distinct().count() >= folds:
        sizes = scored.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).collect()  # one row a group
        load, fold = [0] * folds, {}
        for r in sizes:
            f = min(range(folds), key=lambda i: load[i])
            fold[r[group]] = f
            load[f] += r["n"]
        table = scored.sparkSession.createDataFrame(list(fold.items()), [group, "fold"])
        return scored.join(table, group)
    own = Window.partitionBy("label").orderBy(F.md5(F.concat_ws("|", F.lit("42"), F.col("id").cast("string"))), "id")
    return scored.withColumn("fold", (F.row_number().over(own) - 1) % folds)


def cv_scores(scored: DataFrame, methods: tuple[str, ...] = ("logistic", "isotonic"), metric: str = "brier", folds: int = 5, group: str | None = None) -> dict[str, float]:
    """Mean Brier score or ECE of each method over the folds (id, label, cos)."""
    rows = folded(scored, folds, group).cache()
    out = {}
    for method in methods:
        found = []
        for f in range(folds):
            fitted = FITS[method](rows.where(F.col("fold") != f))
            held = rows.where(F.col("fold") == f).select("label", apply_map(F.col("cos"), fitted).alias("score"))
            found.append(float((M.brier(held) if metric == "brier" else M.ece(held)).first()[0]))
        out[method] = sum(found) / len(found)
    rows.unpersist()
    return out


def calibrate_similarity(scored: DataFrame, method: str = "auto", metric: str = "brier", group: str | None = None) -> dict:
    """The fitted map with its Brier score and ECE; ``auto`` takes the method with the least cross-validated score, logistic of equals."""
    rows = scored.where(M.finite(F.col("cos")))
    scores = cv_scores(rows, metric=metric, group=group) if method == "auto" else {}
    chosen = min(scores, key=scores.get) if scores else method
    fitted = FITS[chosen](rows)
    after = rows.select("label", apply_map(F.col("cos"), fitted).alias("score"))
    return fitted | {"selection": scores, "brier": float(M.brier(after).first()[0]), "ece": float(M.ece(after).first()[0])}


def two_stage(pairs: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], first_threshold: float = 0.5, second_threshold: float = 0.5) -> DataFrame:
    """Pairs the first scorer rejects are settled; only the others go to the second, which decides.

    A scorer adds ``prob``. Result: pair columns, prob, same, stage (``bi-only`` or ``cross``).
    """
    scored = first(pairs)
    low = scored.where(F.col("prob") < first_threshold).withColumn("same", F.lit(False)).withColumn("stage", F.lit("bi-only"))
    high = second(scored.where(F.col("prob") >= first_threshold).drop("prob"))
    high = high.withColumn("same", F.col("prob") >= second_threshold).withColumn("stage", F.lit("cross"))
    return low.unionByName(high)


def style_score(features: Column) -> Column:
    """A number in [0, 1] from style features: the default score where no model is plugged in."""
    return F.round((features["type_token_ratio"] + F.least(F.lit(1.0), 10 * features["punct_ratio"]) + F.least(F.lit(1.0), features["avg_sentence_len"] / 40)) / 3, 6)


def default_score(c: Column) -> Column:
    return style_score(T.style_features(c))
