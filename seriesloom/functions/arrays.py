"""Column functions on arrays of numbers: what the distance operators are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once: inside a lambda it would be worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def std_pop(v: Column) -> Column:
    """Population standard deviation, by deviations from the mean."""
    return let(mean(v), lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v)))


def z_norm(v: Column) -> Column:
    """(x - mean) / std; a flat array becomes zeros."""
    moments = F.struct(mean(v).alias("m"), F.coalesce(F.nullif(std_pop(v), F.lit(0.0)), F.lit(1.0)).alias("s"))
    return let(moments, lambda k: F.transform(v, lambda x: (x - k["m"]) / k["s"]))


def squared(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(squared(x, y))


def norm_euclidean(x: Column, y: Column) -> Column:
    """Euclidean distance over the root of the length."""
    return F.sqrt(squared(x, y) / F.size(x))


def pearson(x: Column, y: Column) -> Column:
    """Correlation, held to -1..1; a flat array counts as of deviation 1, which gives 0."""
    mx, my, sx, sy = mean(x), mean(y), std_pop(x), std_pop(y)
    one = lambda s: F.when(s == 0, F.lit(1.0)).otherwise(s)
    rho = (total(F.zip_with(x, y, lambda a, b: a * b)) / F.size(x) - mx * my) / (one(sx) * one(sy))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))


def pearson_distance(x: Column, y: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - pearson(x, y))))


def barycenter(x: Column, y: Column) -> Column:
    """Point-wise mean of two arrays; past the end of the shorter, the longer's values."""
    return F.zip_with(x, y, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise((a + b) / 2))


def windows(v: Column, length: int) -> Column:
    """All windows of a length, in order; empty if the array is shorter."""
    last = F.size(v) - length
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(v, i + 1, length))).otherwise(F.array().cast("array<array<double>>"))
