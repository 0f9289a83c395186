"""Set similarities and weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hard_overlap(a: Column, b: Column) -> Column:
    """Number of equal pairs of two arrays: repeats multiply.

    For short arrays; ``overlap_by_key`` takes exploded ones of any length.
    """
    return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + F.size(F.filter(b, lambda y: y == x)).cast("long"))


def overlap_by_key(left: DataFrame, right: DataFrame, left_key: str, right_key: str, pairs: DataFrame, item: str) -> DataFrame:
    """(left_key, right_key, overlap) of exploded multisets for given pairs.

    Items are counted per key first, so a repeated item meets its partner once.
    """
    a = left.groupBy(left_key, item).agg(F.count("*").alias("_na"))
    b = right.groupBy(right_key, item).agg(F.count("*").alias("_nb"))
    met = pairs.join(a, left_key).join(b, [right_key, item])
    summed = met.groupBy(left_key, right_key).agg(F.sum(F.col("_na") * F.col("_nb")).alias("overlap"))
    return pairs.join(summed, [left_key, right_key], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long")))


def tversky_contrast(alpha: float, beta: float, gamma: float, overlap: Column, only_a: Column, only_b: Column) -> Column:
    return F.lit(alpha) * overlap - F.lit(beta) * only_a - F.lit(gamma) * only_b


def tversky_ratio(alpha: float, beta: float, gamma: float, overlap: Column, only_a: Column, only_b: Column) -> Column:
    """The overlap's part of the contrast; 0 where the contrast is 0."""
    contrast = tversky_contrast(alpha, beta, gamma, overlap, only_a, only_b)
    return F.when(contrast == 0, F.lit(0.0)).otherwise(F.lit(alpha) * overlap / contrast)


def jaccard_count(overlap: Column, union: Column) -> Column:
    return F.when(union == 0, F.lit(0.0)).otherwise(overlap / union)


def jaccard(a: Column, b: Column) -> Column:
    """Equal pairs over the summed sizes: equal singletons give 0.5."""
    return jaccard_count(hard_overlap(a, b), F.size(a) + F.size(b))


def geometric_mean(value: Column, weight: Column, floor: float = 1e-5) -> Column:
    """Aggregate: (product of value ** weight) ** (1 / n), values floored.

    Null values are skipped in the product but counted in n; a group of nulls
    gives 1, no rows give null. Logarithms keep the product from underflow.
    """
    logs = F.when(value.isNotNull(), weight * F.ln(F.greatest(value, F.lit(floor))))
    return F.when(F.count(F.lit(1)) > 0, F.exp(F.coalesce(F.sum(logs), F.lit(0.0)) / F.count(F.lit(1))))


def arithmetic_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum of value * weight over the number of rows."""
    return F.sum(value * weight) / F.count(F.lit(1))
