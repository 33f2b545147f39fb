"""Quality of candidates, from order lines: the distances of all series to a candidate, with labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.order_lines import SCORES
from ..tables import store


def order_line(dist: DataFrame, digits: int = 5) -> DataFrame:
    """dm(cand, dist, label) of min_distances' rows, rounded so that equal distances are equal and thresholds, means of two, have one digit more."""
    return dist.select(F.col("cand_id").alias("cand"), F.round("dist", digits).alias("dist"), "label")


def score(line: DataFrame, metric: str = "ig") -> DataFrame:
    """(cand, score) for f, kw and mm; (cand, gain, gap, tau) for ig.  Lines without a split: null, or no row for ig."""
    if metric not in SCORES:
        raise KeyError(metric)
    return line.sparkSession.sql(SCORES[metric], dm=line)


def scores(line: DataFrame, metric: str = "ig") -> DataFrame:
    """(cand, score, gap, tau) of every candidate; a candidate that can't be scored has null."""
    found = score(line, metric)
    found = found.withColumnRenamed("gain", "score") if metric == "ig" else found.select("cand", "score", F.lit(None).cast("double").alias("gap"), F.lit(None).cast("double").alias("tau"))
    return line.select("cand").distinct().join(found, "cand", "left")


def spread_gains(line: DataFrame) -> DataFrame:
    """What score(line, "ig") gives, for lines of any length: the points of one line are many tasks.

    Points are folded by distance and cut into ranges of (cand, dist), so that equal distances share a range.  A first pass counts classes and sums
    distances of each range; their running sums are what lies before a range.  A second pass adds them to the running sums within the range and
    scores every cut; the best cut of a line is a minimum.  Rows for a line's ranges, not its points, meet in one task.
    """
    # The classes are few: each is a column.
    labels = [r.label for r in line.select("label").distinct().orderBy("label").collect()]
    if not labels:
        return line.sparkSession.createDataFrame([], "cand bigint, gain double, gap double, tau double")
    counts = [f"n{i}" for i in range(len(labels))]
    per = [F.sum(F.when(F.col("label").eqNullSafe(F.lit(c)), 1).otherwise(0)).alias(n) for c, n in zip(labels, counts, strict=True)]
    points = line.groupBy("cand", "dist").agg(*per, F.sum("dist").alias("s"))
    points = store(points.repartitionByRange("cand", "dist").withColumn("part", F.spark_partition_id()), "line-points")
    summed = [*counts, "s"]
    ranges = points.groupBy("cand", "part").agg(F.min("dist").alias("first"), *[F.sum(c).alias(c) for c in summed])
    order = Window.partitionBy("cand").orderBy("part")
    before = [(F.sum(c).over(order) - F.col(c)).alias(f"before_{c}") for c in summed]
    whole = [F.sum(c).over(Window.partitionBy("cand")).alias(f"all_{c}") for c in summed]
    ranges = store(ranges.select("cand", "part", *before, *whole, F.lead("first").over(order).alias("after")), "line-ranges")
    inside = Window.partitionBy("cand", "part").orderBy("dist")
    left = [(F.sum(c).over(inside) + F.col(f"before_{c}")).alias(f"left_{c}") for c in summed]
    cuts = points.join(ranges, ["cand", "part"]).select("cand", "dist", F.coalesce(F.lead("dist").over(inside), F.col("after")).alias("next"), *left, *[f"all_{c}" for c in summed]).where("next IS NOT NULL")
    add = lambda cs: sum(cs[1:], cs[0])
    plog = lambda c: F.when(c > 0, c * F.log(c.cast("double"))).otherwise(F.lit(0.0))
    lefts, alls = [F.col(f"left_{c}") for c in counts], [F.col(f"all_{c}") for c in counts]
    rights = [a - b for a, b in zip(alls, lefts, strict=True)]
    nl, nr, n = add(lefts), add(rights), add(alls)
    entropy = lambda total, of: plog(total) - add([plog(c) for c in of])
    gain = F.round((entropy(n, alls) - entropy(nl, lefts) - entropy(nr, rights)) / n, 9)
    gap = F.round((F.col("all_s") - F.col("left_s")) / nr - F.col("left_s") / nl, 9)
    scored = cuts.select("cand", gain.alias("gain"), gap.alias("gap"), ((F.col("dist") + F.col("next")) / 2).alias("tau"))
    best = scored.groupBy("cand").agg(F.min(F.struct((-F.col("gain")).alias("a"), (-F.col("gap")).alias("b"), "tau")).alias("best"))
    return best.select("cand", F.round(-F.col("best.a"), 6).alias("gain"), F.round(-F.col("best.b"), 6).alias("gap"), F.round("best.tau", 6).alias("tau"))


def class_distances(line: DataFrame) -> DataFrame:
    """(cand, label, n, distances): sorted distances by class."""
    return line.groupBy("cand", "label").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("dist")).alias("distances"))


def gain_bound(line: DataFrame, radius: float) -> DataFrame:
    """(cand, bound): the largest gain over all thresholds if every point within radius of one went to the side that its class favours.

    A class favours the side of which it has the larger share; with equal shares its points stay.  For more than two classes an estimate.
    Lines without a threshold give 0.
    """
    # Equal points are one row: a line has as many rows as its distances, to the digits of order lines, have values.
    points = line.groupBy("cand", F.col("dist").cast("double").alias("x"), "label").agg(F.count(F.lit(1)).alias("w"))
    xlogx = lambda x: x * np.log(np.maximum(x, 1))

    def bound(rows: pa.Table) -> pa.Table:
        x, at = np.unique(rows["x"].to_numpy(), return_inverse=True)
        kind = np.unique(rows["label"].fill_null(-1).to_numpy(), return_inverse=True)[1]
        best = 0.0
        if len(x) > 1:
            classes = int(kind.max()) + 1
            cuts = (x[:-1] + x[1:]) / 2
            # Running counts of a class: what lies before a place is one look-up.
            low, high = np.searchsorted(x, cuts - radius, "left"), np.searchsorted(x, cuts + radius, "right")
            sides = []
            for c in range(classes):
                mine = kind == c
                upto = np.concatenate(([0], np.cumsum(np.bincount(at[mine], rows["w"].to_numpy()[mine], len(x)))))
                left = upto[1:-1]
                sides.append((upto[-1], left, left - upto[low], upto[high] - left))
            n = sum(s[0] for s in sides)
            all_left = sum(s[1] for s in sides)
            inside, lefts = np.zeros(len(cuts)), np.zeros(len(cuts))
            for size, left, near, far in sides:
                share = left * (n - size - all_left + left) - (size - left) * (all_left - left)
                moved = np.where(share > 0, left + far, np.where(share < 0, left - near, left))
                inside += xlogx(moved) + xlogx(size - moved)
                lefts += moved
            best = float((xlogx(n) - sum(xlogx(s[0]) for s in sides) - xlogx(lefts) - xlogx(n - lefts) + inside).max() / n)
        return pa.table([rows["cand"][:1], pa.array([max(best, 0.0)])], names=["cand", "bound"])

    found = points.groupBy("cand").applyInArrow(bound, f"cand {dict(line.dtypes)['cand']}, bound double")
    return found.select("cand", F.round("bound", 6).alias("bound"))
