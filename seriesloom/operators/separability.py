"""How well features(series_id, label, v) separate the classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("series_id", "label", F.posexplode("v").alias("dim", "x"))


def scatter_ratio(rows: DataFrame) -> DataFrame:
    """(ratio): trace of the scatter between classes over that of between plus within, from per-dimension moments.

    Within: the sum of the classes' sample variances; between: of class size times the squared distance of means.
    """
    long = _long(rows)
    by_class = long.groupBy("label", "dim").agg(F.avg("x").alias("m"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = long.groupBy("dim").agg(F.avg("x").alias("g"))
    t = by_class.join(whole, "dim").agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("b"), F.sum("s").alias("w"))
    return t.select(F.round(F.try_divide("b", F.col("b") + F.col("w")), 6).alias("ratio"))


def centroids(rows: DataFrame) -> DataFrame:
    """(label, center): the mean of each class's arrays."""
    means = _long(rows).groupBy("label", "dim").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("c")).select("label", F.transform("c", lambda e: e["x"]).alias("center"))


def davies_bouldin(rows: DataFrame) -> DataFrame:
    """(dbi): the mean over classes of the largest (s_k + s_l) / d_kl to another class; infinite if undefined."""
    c = centroids(rows)
    spread = rows.join(F.broadcast(c), "label").groupBy("label").agg(F.avg(A.euclidean(F.col("v"), F.col("center"))).alias("s"))
    c = c.join(spread, "label")
    pairs = c.alias("a").join(c.alias("b"), F.col("a.label") != F.col("b.label"))
    ratio = (F.col("a.s") + F.col("b.s")) / F.nullif(A.euclidean(F.col("a.center"), F.col("b.center")), F.lit(0.0))
    worst = pairs.select(F.col("a.label").alias("label"), ratio.alias("r")).groupBy("label").agg(F.max("r").alias("r"))
    return worst.agg(F.round(F.coalesce(F.avg("r"), F.lit(float("inf"))), 6).alias("dbi"))


def bhattacharyya(rows: DataFrame, dims: tuple[int, ...] | None = None, cells: int = 10) -> DataFrame:
    """(coefficient): the sum over grid cells of the K-th root of the product of the K classes' shares, in logarithms.

    Only cells that hold a series are there, so any number of dimensions (by default all that the longest series has) will do.  Each kept dimension is cut into ``cells`` of equal width, the largest value in a cell of its own; dimensions of a range
    under 1e-5 are left out, and if none is left the classes coincide (1).
    """
    dims = tuple(range(rows.agg(F.max(F.size("v"))).first()[0] or 0)) if dims is None else dims
    x = [F.try_element_at("v", F.lit(d + 1)) for d in dims]
    if not dims:
        return rows.sparkSession.sql("SELECT 1.0D AS coefficient")
    ends = rows.agg(*[f(e).alias(f"{n}{i}") for i, e in enumerate(x) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    used = [i for i in range(len(dims)) if ends[f"hi{i}"] is not None and ends[f"hi{i}"] - ends[f"lo{i}"] >= 1e-5]
    spark = rows.sparkSession
    if not used:
        return spark.sql("SELECT 1.0D AS coefficient")
    cell = F.array(*[F.floor((x[i] - ends[f"lo{i}"]) / ((ends[f"hi{i}"] - ends[f"lo{i}"]) / cells)) for i in used])
    counted = rows.select("label", cell.alias("cell")).groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    k = sizes.count()
    shares = counted.join(F.broadcast(sizes), "label").groupBy("cell").agg(F.sum(F.log(F.col("n") / F.col("size"))).alias("logs"), F.count(F.lit(1)).alias("k"))
    return shares.agg(F.round(F.coalesce(F.sum(F.when(F.col("k") == k, F.exp(F.col("logs") / k))), F.lit(0.0)), 6).alias("coefficient"))


def nearest_neighbours(rows: DataFrame, others: DataFrame | None = None, k: int = 1) -> DataFrame:
    """(series_id, label, other_id, other_label, dist, place) of the k nearest other rows; ties by id.

    The other side goes round in blocks of a bounded size; each task keeps k rows per series and block.
    """
    from .blocks import nearest

    return nearest(rows, others if others is not None else rows, k, same=others is None)


def separability_index(rows: DataFrame) -> DataFrame:
    """(si): the share of rows whose nearest neighbour has their label."""
    near = nearest_neighbours(rows)
    return near.agg(F.round(F.avg((F.col("label") == F.col("other_label")).cast("double")), 6).alias("si"))


def _shares(rows: DataFrame, bins: int, joint: bool) -> DataFrame:
    """(key, label, p): the share of each class's series in each cell.

    Every dimension is cut into bins of equal width over its whole range.  A cell is a dimension and a bin, or, if joint, the bins of all
    dimensions together; only cells that hold a series are there.  Null values are in no cell.
    """
    long = _long(rows).where("x IS NOT NULL")
    ends = long.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.coalesce(F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0)), F.lit(1.0))
    cells = long.join(ends, "dim").select("series_id", "label", "dim", F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / width)).alias("bin"))
    if joint:
        cell = F.to_json(F.sort_array(F.collect_list(F.struct("dim", "bin"))))
        cells = cells.groupBy("series_id", "label").agg(cell.alias("bin")).withColumn("dim", F.lit(None).cast("int"))
    counts = cells.groupBy("dim", "bin", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(F.col("dim").alias("of"), F.col("label").alias("whose")).agg(F.sum("n").alias("size"))
    return counts.join(sizes, F.col("dim").eqNullSafe(F.col("of")) & F.col("label").eqNullSafe(F.col("whose"))).select("dim", "bin", "label", (F.col("n") / F.col("size")).alias("p"))


def jensen_shannon(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(dim, label_a, label_b, jsd) of every pair of classes' histograms, for every dimension over its whole range (natural logarithm)."""
    p = _shares(rows, bins, False)
    a, b = (p.select("dim", "bin", F.col("label").alias(f"label_{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
    m = (F.col("pa") + F.col("pb")) / 2
    met = a.join(b, ["dim", "bin"]).where("label_a < label_b").groupBy("dim", "label_a", "label_b").agg(F.sum(F.col("pa") + F.col("pb")).alias("shared"), F.sum(F.col("pa") * F.log(F.col("pa") / m) + F.col("pb") * F.log(F.col("pb") / m)).alias("s"))
    labels = p.select("dim", "label").distinct()
    pairs = labels.withColumnRenamed("label", "label_a").join(labels.withColumnRenamed("label", "label_b"), "dim").where("label_a < label_b")
    # Where only one of the two has a series, its share counts ln 2.
    both = pairs.join(met, ["dim", "label_a", "label_b"], "left").na.fill(0.0, ["shared", "s"])
    return both.select("dim", "label_a", "label_b", F.round((F.col("s") + (2 - F.col("shared")) * F.log(F.lit(2.0))) / 2, 6).alias("jsd"))


def jensen_shannon_mixture(rows: DataFrame, bins: int = 10, weight: float = 0.5, joint: bool = False) -> DataFrame:
    """(dim, jsd) of all classes at once: ``weight`` times the sum of their divergences from the mean of their histograms.

    joint: one value for the histogram over all dimensions together (dim is null); its cells are those that hold a series.  Two
    classes and a weight of a half give the usual divergence.
    """
    p = _shares(rows, bins, joint)
    classes = p.groupBy(F.col("dim").alias("of")).agg(F.countDistinct("label").alias("k"))
    mean = p.groupBy(F.col("dim").alias("d"), F.col("bin").alias("b")).agg(F.sum("p").alias("m"))
    both = p.join(mean, F.col("dim").eqNullSafe(F.col("d")) & (F.col("bin") == F.col("b"))).join(F.broadcast(classes), F.col("dim").eqNullSafe(F.col("of")))
    return both.groupBy("dim").agg(F.round(weight * F.sum(F.col("p") * F.log(F.col("p") * F.col("k") / F.col("m"))), 6).alias("jsd"))
