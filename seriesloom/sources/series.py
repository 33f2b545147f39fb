"""Labelled series from tables and files: one row per series, values in an array column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ..tables import store


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, label, v) of ``embeddings``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("series_id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def event_series(spark: SparkSession, sf_dir: str, days: int = 30, first: str = "2024-01-01") -> DataFrame:
    """(series_id, label, v): per user of ``events`` the daily sums of value, days without events as 0; label: user_id mod 2."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.datediff(F.col("ts"), F.lit(first)).alias("day"), "value")
    daily = rows.where(F.col("day").between(0, days - 1)).groupBy("user_id", "day").agg(F.sum("value").alias("x"))
    by_day = daily.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "x"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0)))
    return by_day.select(F.col("user_id").alias("series_id"), F.pmod("user_id", F.lit(2)).cast("int").alias("label"), values.alias("v"))


def cumulated(rows: DataFrame) -> DataFrame:
    """rows(series_id, v) with the running sums of v; label: 1 for series whose total is over the mean total, else 0."""
    added = F.aggregate("v", F.array().cast("array<double>"), lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x))
    rows = rows.select("series_id", added.alias("v")).withColumn("total", F.try_element_at("v", F.lit(-1)))
    mean = F.broadcast(rows.agg(F.avg("total").alias("mean")))
    return rows.join(mean).select("series_id", (F.col("total") > F.col("mean")).cast("int").alias("label"), "v")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, x): the values of each user's events in order of time; lengths differ."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("user_id").alias("series_id"), (F.row_number().over(order) - 1).alias("t"), F.col("value").alias("x"))


def numbered(rows: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """rows with their number (from 0) in an order, which no task sees whole: ranges are sorted apart and start where those before them end."""
    ordered = store(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "series-order")
    part = F.shiftright(name, 33)
    sizes = ordered.groupBy(part.alias("seriesloom_part")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each partition.
    sizes = sizes.select("seriesloom_part", (F.sum("n").over(Window.orderBy("seriesloom_part")) - F.col("n")).alias("seriesloom_before"))
    number = F.col("seriesloom_before") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(sizes), part == F.col("seriesloom_part")).select(*rows.columns, number.alias(name))


def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, x): the values of all events in order of time, as one sequence of one dimension."""
    rows = numbered(spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "value"), "ts", "event_id")
    return rows.select(F.lit(0).cast("long").alias("seq_id"), "pos", F.array("value").alias("x"))


def customer_series(spark: SparkSession, sf_dir: str, months: int = 80) -> DataFrame:
    """(series_id, label, v): per customer the monthly sums of order prices from 1995-01 on; label: dense rank of the market segment."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).alias("month"), F.col("o_totalprice").cast("double").alias("x"))
    monthly = orders.where(F.col("month").between(0, months - 1)).groupBy("o_custkey", "month").agg(F.sum("x").alias("x"))
    by_month = monthly.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("month", "x"))).alias("m"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("raw_label"))
    values = F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0)))
    joined = by_month.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = joined.select(F.col("o_custkey").alias("series_id"), "raw_label", values.alias("v"))
    return densify(rows, rows).select("series_id", "label", "v")


def densify(rows: DataFrame, train: DataFrame, raw: str = "raw_label") -> DataFrame:
    """rows with ``label``: the rank (from 0) of the raw label among those of train; null for labels that train lacks."""
    labels = train.select(raw).where(F.col(raw).isNotNull()).distinct()
    ranked = labels.select(F.col(raw).alias("known"), (F.row_number().over(Window.orderBy(raw)) - 1).alias("label"))
    return rows.join(ranked, F.col(raw) == F.col("known"), "left").drop("known")


def read_wide_csv(spark: SparkSession, path: str, target: str = "target") -> DataFrame:
    """(file, series_id, raw_label, v) of CSV files with one numeric column per time step and a target column.

    Files may be many (a folder or a pattern), of one schema; series_id is a hash of the row and its file.
    """
    rows = spark.read.csv(path, header=True, inferSchema=True)
    if target not in rows.columns:
        raise ValueError(f"no column {target}")
    steps = [c for c in rows.columns if c != target]
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in steps])
    file = F.input_file_name()
    return rows.select(file.alias("file"), F.xxhash64(file, values, F.col(target)).alias("series_id"), F.col(target).alias("raw_label"), values.alias("v"))


def catalogue(wide: DataFrame) -> DataFrame:
    """Per file of read_wide_csv: n_samples, n_features, n_classes, and split (train, test or all) from the file's name."""
    name = F.regexp_extract("file", r"([^/]+)\.csv[^/]*$", 1)
    split = F.when(name.endswith("_train"), "train").when(name.endswith("_test"), "test").otherwise("all")
    return wide.groupBy(F.regexp_replace(name, "_(train|test)$", "").alias("name"), split.alias("split")).agg(
        F.count(F.lit(1)).alias("n_samples"), F.max(F.size("v")).alias("n_features"), F.countDistinct("raw_label").alias("n_classes")
    )


def read_shapelet_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, rank, values) of text files with bracketed arrays, by commas or white space, over one or more lines each."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parts = files.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(r"\[([^\[\]]*)\]"), F.lit(1))).alias("rank", "body"))
    return parts.select("file", "rank", F.split(F.trim(F.regexp_replace("body", r"[,\s]+", " ")), " ").cast("array<double>").alias("values"))


def write_shapelet_text(shapelets: DataFrame, path: str) -> None:
    """One JSON array of values per line, in order of rank."""
    shapelets.orderBy("rank").select(F.to_json("values").alias("value")).write.text(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_id, prediction) of prediction files: a row number without a name, then ``prediction``."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    return rows.select(F.input_file_name().alias("file"), F.col(f"`{rows.columns[0]}`").cast("long").alias("row_id"), F.col("prediction").cast("int").alias("prediction"))


def read_runtimes(spark: SparkSession, path: str) -> DataFrame:
    """(file, seconds) of files that hold one number."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").try_cast("double").alias("seconds")).where("seconds IS NOT NULL")


def write_predictions(rows: DataFrame, path: str) -> None:
    """rows(row_id, prediction) as CSV files that read_predictions reads."""
    rows.select("row_id", "prediction").write.csv(path, header=True)


def write_runtime(spark: SparkSession, seconds: float, path: str) -> None:
    """One number, as read_runtimes reads it."""
    spark.range(1).select(F.lit(str(float(seconds))).alias("value")).write.text(path)


def write_measurements(rows: DataFrame, path: str) -> None:
    """Points of a sweep with what was measured, one CSV row each, added to those of earlier runs."""
    rows.write.mode("append").csv(path, header=True)


#: Rows that are drawn from together.
DRAW_BLOCK = 1 << 16


def draws(block: int, rows: int, size: int, seed: int) -> np.ndarray:
    """How often each row of a block of DRAW_BLOCK is drawn when ``size`` are drawn from ``rows`` with replacement.

    The number for the block comes from halving: of the draws from a range of blocks a binomial number falls into its first half.  The numbers of
    all blocks add up to size whichever task asks, as a range's number hangs on the seed and the range alone.
    """
    low, high = 0, max(1, -(-rows // DRAW_BLOCK))
    upto = lambda b: min(b * DRAW_BLOCK, rows)
    while high - low > 1:
        middle = (low + high) // 2
        first = np.random.default_rng([seed, low, high]).binomial(size, (upto(middle) - upto(low)) / (upto(high) - upto(low)))
        if block < middle:
            high, size = middle, int(first)
        else:
            low, size = middle, size - int(first)
    n = upto(high) - upto(low)
    return np.bincount(np.random.default_rng([seed, low, high]).integers(0, n, size), minlength=n) if n else np.zeros(0, np.int64)


def bootstrap(rows: DataFrame, share: float = 1.0, seed: int = 1337) -> DataFrame:
    """round(share * n) of the n rows(series_id, ..), drawn with replacement, each row by itself: equal series_ids are drawn apart.

    Rows are numbered in the order of series_id and a hash of the row by ranges, and every block of numbers knows how often its rows are drawn, so no task and
    not the driver sees all.  Reruns agree, but for which of several equal rows it is.
    """
    if share < 0:
        raise ValueError("share is 0 or more")
    ship(rows.sparkSession)
    order = "seriesloom_order"
    n = rows.count()
    size = round(share * n)
    placed = numbered(rows.withColumn(order, F.xxhash64(F.to_json(F.struct("*")))), F.asc_nulls_first("series_id"), order, name="seriesloom_place").drop(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, times = -1, None
        for batch in batches:
            place = batch.column("seriesloom_place").to_numpy()
            count = np.zeros(len(place), np.int64)
            for b in np.unique(place // DRAW_BLOCK):
                if b != block:
                    block, times = int(b), draws(int(b), n, size, seed)
                own = place // DRAW_BLOCK == b
                count[own] = times[place[own] % DRAW_BLOCK]
            yield batch.take(pa.array(np.repeat(np.arange(len(place)), count)))

    return placed.mapInArrow(run, placed.schema).drop("seriesloom_place")


def sizes_of(shapelets: DataFrame, seed: int = 1337) -> dict[int, int]:
    """{length: arrays} for learning, from found shapelets(file, values): as many lengths as a file has on average, drawn as they occur."""
    counts = shapelets.groupBy(F.size("values").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    if not counts:
        return {}
    files, total = shapelets.select("file").distinct().count(), sum(r.n for r in counts)
    drawn = np.random.default_rng(seed).multinomial(max(1, total // files), [r.n / total for r in counts])
    return {r.length: int(k) for r, k in zip(counts, drawn, strict=True) if k}


def stratified(rows: DataFrame, per_label: int, key: Column | None = None) -> DataFrame:
    """per_label rows of each label, those of the least key (by default a hash of series_id)."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("series_id") if key is None else key, "series_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_label).drop("place")


def split(rows: DataFrame, train_share: float = 0.5, key: Column | None = None) -> DataFrame:
    """rows with ``part`` (train or test), the share held in every label."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("series_id") if key is None else key, "series_id")
    place = F.row_number().over(order)
    n = F.count(F.lit(1)).over(Window.partitionBy("label"))
    return rows.withColumn("part", F.when(place <= F.ceil(n * train_share), "train").otherwise("test"))


def valid(rows: DataFrame) -> DataFrame:
    """rows whose series has a value, and no null, NaN or infinite one."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
