"""Dense vectors and scores as columns over array<double>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; vectors of different sizes are an error."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors differ in size")).cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    return dot(a, b) / ((norm(a) + floor) * (norm(b) + floor))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def clamp(x: Column, low, high) -> Column:
    low, high = (c if isinstance(c, Column) else F.lit(c) for c in (low, high))
    return F.greatest(low, F.least(high, x))


def mean_vectors(df: DataFrame, key: str, vector: str, into: str = "v") -> DataFrame:
    """Element-wise mean of all vectors of a key; partial sums are made before the shuffle."""
    each = df.select(key, F.posexplode(vector).alias("k", "x"))
    means = each.groupBy(key, "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("k", "x")))
    return means.groupBy(key).agg(F.transform(ordered, lambda s: s["x"]).alias(into))
