"""Evaluation of predictions(series_id, label, prediction) and of repeated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 6).alias("accuracy"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def log_loss(rows: DataFrame, least: float = 1e-15) -> DataFrame:
    """(log_loss) of rows(label, probabilities map<int,double>); a class without a probability has ``least``."""
    p = F.greatest(F.coalesce(F.try_element_at("probabilities", F.col("label")), F.lit(0.0)), F.lit(least))
    return rows.agg(F.round(-F.avg(F.log(p)), 6).alias("log_loss"))


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and population deviation per group."""
    return rows.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"), F.count(F.lit(1)).alias("n"))


def wilcoxon(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, w_plus, w_minus, statistic) of the signed ranks of a - b; zero differences are left out, ties share ranks."""
    d = rows.select(F.round(F.col(a) - F.col(b), 9).alias("d")).where("d <> 0")
    by = d.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    sizes = by.groupBy(F.abs("d").alias("a")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("n")).otherwise(0)).alias("up"))
    upto = F.sum("n").over(Window.orderBy("a"))
    ranked = sizes.withColumn("rank", upto - (F.col("n") - 1) / 2)
    plus, minus = F.sum(F.col("rank") * F.col("up")), F.sum(F.col("rank") * (F.col("n") - F.col("up")))
    return ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), plus.alias("w_plus"), minus.alias("w_minus"), F.least(plus, minus).alias("statistic"))


def paired_t(rows: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return rows.agg(F.count(d).alias("n"), F.round(F.avg(d) / F.nullif(F.stddev_samp(d) / F.sqrt(F.count(d)), F.lit(0.0)), 6).alias("t"))


def length_percentiles(shapelets: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """(low, high): percentiles of length by linear interpolation: bounds for a wider search."""
    p = F.percentile("length", F.array(F.lit(low), F.lit(high)))
    return shapelets.agg(p.alias("p")).select(F.round(F.col("p")[0], 6).alias("low"), F.round(F.col("p")[1], 6).alias("high"))


def shapelet_sizes(series_length: int, base: float, scales: int, per_scale: int) -> dict[int, int]:
    """{floor(base * series_length) * i: per_scale} for i from 1 to scales."""
    unit = int(base * series_length)
    return {unit * i: per_scale for i in range(1, scales + 1)}
