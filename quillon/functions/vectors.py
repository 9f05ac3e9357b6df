"""Vectors as arrays of doubles: Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, eps: float = 0.0) -> Column:
    """``v`` over its norm; zeros stay zeros."""
    n = norm(v) + F.lit(eps)
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Null if either has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.greatest(dot(a, a) + dot(b, b) - 2 * dot(a, b), F.lit(0.0))


def pair_features(a: Column, b: Column, *more: Column) -> Column:
    """Both vectors, their absolute difference, their product, and more arrays."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y), *more)


def zero_to_one(cos: Column) -> Column:
    """(cos + 1) / 2; NaN stays NaN, null stays null."""
    return F.when(F.isnan(cos), cos).otherwise((cos + 1) / 2)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def probability(logit0: Column, logit1: Column, temperature: float = 1.0) -> Column:
    """Softmax probability of class 1."""
    return 1 / (1 + F.exp((logit0 - logit1) / max(temperature, 1e-6)))


def masked_mean(rows: Column, mask: Column) -> Column:
    """Mean of the vectors (array of arrays) whose mask is not 0; null if there is none."""
    kept = F.transform(F.filter(F.arrays_zip(rows.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.try_element_at(kept, F.lit(1)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(kept))


def moving_average(values: Column, keep: float = 0.9) -> Column:
    """Exponential moving average of an array, from its first value; null if it is empty."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(a * keep + x * (1 - keep)))


def cross_entropy(logits: Column, label: Column, weights: Column | None = None) -> Column:
    """-log softmax at ``label`` (from 0), times the class weight."""
    top = F.array_max(logits)
    log_sum = top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z - top)))
    loss = log_sum - F.element_at(logits, label.cast("int") + 1)
    return loss * F.element_at(weights, label.cast("int") + 1) if weights is not None else loss


def distillation_loss(student: Column, teacher: Column, temperature: float = 2.0) -> Column:
    """T^2 times the divergence of the student's softmax from the teacher's, both at temperature T."""

    def softened(z: Column) -> Column:
        top = F.array_max(z)
        e = F.transform(z, lambda x: F.exp((x - top) / temperature))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))

    parts = F.zip_with(softened(teacher), softened(student), lambda p, q: F.when(p > 0, p * F.log(p / q)).otherwise(0.0))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) * (temperature * temperature)


def margin_logits(vec: Column, weights: Column, label: Column | None = None, scale: float = 30.0, margin: float = 0.2) -> Column:
    """scale x the cosine with each class vector; at the label, of the angle made greater by the margin.

    Angles too near to pi for that lose ``sin(margin) * margin`` of their cosine instead. Vectors without length have
    cosine 0.
    """
    cos = F.transform(weights, lambda w: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(cosine(vec, w), F.lit(0.0)))))
    if label is None:
        return F.transform(cos, lambda x: x * scale)
    turned = lambda x: F.when(x > -math.cos(margin), F.cos(F.acos(x) + margin)).otherwise(x - math.sin(margin) * margin)
    return F.transform(cos, lambda x, i: F.when(i == label, turned(x)).otherwise(x) * scale)
