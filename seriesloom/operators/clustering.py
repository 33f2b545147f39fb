"""Clusters of series under warping, and how well clusters hold together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .blocks import dtw

#: Rows whose tables of costs a task holds together.
PATHS = 256


def warped_sums(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) by point of the centre: the points of all rows of x that the best warping paths match with it.

    Of equally good steps a path takes the diagonal one first, then the one along x.
    """
    p, n, m = len(x), x.shape[1], len(centre)
    cost = np.full((p, n + 1, m + 1), np.inf)
    cost[:, 0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            least = np.minimum(np.minimum(cost[:, i - 1, j - 1], cost[:, i - 1, j]), cost[:, i, j - 1])
            cost[:, i, j] = (x[:, i - 1] - centre[j - 1]) ** 2 + least
    sums, counts = np.zeros(m), np.zeros(m, np.int64)
    row, i, j = np.arange(p), np.full(p, n), np.full(p, m)
    while len(row):
        np.add.at(sums, j - 1, x[row, i - 1])
        np.add.at(counts, j - 1, 1)
        steps = np.stack((cost[row, i - 1, j - 1], cost[row, i - 1, j], cost[row, i, j - 1]))
        step = steps.argmin(0)
        i, j = i - (step < 2), j - (step != 1)
        live = (i > 0) & (j > 0)
        row, i, j = row[live], i[live], j[live]
    return sums, counts


@dataclass
class WarpedKMeans:
    """Lloyd steps under dynamic time warping; a centre moves to the means of what the paths of its series match with each of its points.

    Centres start as k series, in the order of a hash of series_id; they keep the starts' lengths.  A step is one job: tasks add up sums by
    centre and point, the shuffle adds the tasks' sums; k centres are on the driver.  Ties go to the smaller centre; a centre without series stays.
    """

    k: int = 3
    rounds: int = 5
    seed: int = 1337
    centres: list[np.ndarray] = field(default_factory=list)
    inertia: list[float] = field(default_factory=list)

    def fit(self, series: DataFrame) -> WarpedKMeans:
        ship(series.sparkSession)
        rows = series.where(F.size("v") > 0).select("series_id", "v")
        self.centres = [np.array(r.v, np.float64) for r in rows.orderBy(F.xxhash64("series_id", F.lit(self.seed)), "series_id", "v").limit(self.k).collect()]
        self.inertia = []
        for _ in range(self.rounds if self.centres else 0):
            sums = self._sums(rows).groupBy("centre", "point").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
            self.inertia.append(sum(r.total for r in sums if r.point < 0))
            for r in sums:
                if r.point >= 0:
                    self.centres[r.centre][r.point] = r.total / r.n
        return self

    @staticmethod
    def _nearest(values: list, centres: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places, x, centre, distance) of series of one length at a time."""
        lengths = np.array([len(v) for v in values])
        for n in np.unique(lengths):
            places = np.flatnonzero(lengths == n)
            for at in range(0, len(places), PATHS):
                part = places[at : at + PATHS]
                x = np.array([values[i] for i in part], np.float64)
                d = np.round(np.column_stack([dtw(x, c[None])[:, 0] for c in centres]), 9)
                best = d.argmin(1)
                yield part, x, best, d[np.arange(len(x)), best]

    def _sums(self, rows: DataFrame) -> DataFrame:
        shared, nearest = rows.sparkSession.sparkContext.broadcast(self.centres), self._nearest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            total = [[np.zeros(len(c)), np.zeros(len(c), np.int64), 0.0] for c in centres]
            for batch in batches:
                for _, x, best, d in nearest(batch.column(0).to_pylist(), centres):
                    for c in np.unique(best):
                        sums, counts = warped_sums(x[best == c], centres[c])
                        total[c][0] += sums
                        total[c][1] += counts
                        total[c][2] += float((d[best == c] ** 2).sum())
            for c, (sums, counts, inertia) in enumerate(total):
                if counts.any():
                    # Point -1 has the squared distances.
                    yield pa.RecordBatch.from_arrays([pa.array([c] * (len(sums) + 1), pa.int32()), pa.array(range(-1, len(sums)), pa.int32()), pa.array([inertia, *sums]), pa.array([1, *counts.tolist()], pa.int64())], ["centre", "point", "total", "n"])

        return rows.select("v").mapInArrow(run, "centre int, point int, total double, n bigint")

    def predict(self, series: DataFrame) -> DataFrame:
        """(series_id, cluster, dist) of every series with a value."""
        ship(series.sparkSession)
        shared, nearest = series.sparkSession.sparkContext.broadcast(self.centres), self._nearest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for places, _, best, d in nearest(batch.column(1).to_pylist(), shared.value) if shared.value else ():
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(best.astype(np.int32)), pa.array(d)], ["series_id", "cluster", "dist"])

        rows = series.where(F.size("v") > 0).select(F.col("series_id").cast("long").alias("series_id"), "v")
        return rows.mapInArrow(run, "series_id bigint, cluster int, dist double")


def _moments(rows: DataFrame) -> DataFrame:
    """(cluster, n, q, s): rows, sum of squared values and sums by point of every cluster of rows(cluster, v)."""
    long = rows.select("cluster", F.posexplode("v").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    whole = long.groupBy("cluster").agg(F.sum("q").alias("q"), F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda e: e["s"]).alias("s"))
    return sizes.join(whole, "cluster").select("cluster", "n", "q", "s")


def _filled(rows: DataFrame) -> DataFrame:
    return rows.where((F.size("v") > 0) & F.col("cluster").isNotNull())


def silhouettes(rows: DataFrame) -> DataFrame:
    """(series_id, cluster, silhouette) of rows(series_id, cluster, v), for squared Euclidean distances; arrays of one length.

    The mean distance of a row to all rows of a cluster comes from the cluster's size, sum and squares, so no pairs are made.  A row that is
    alone in its cluster has 0; with a single cluster all have 0.  Rows without a value or a cluster are left out.
    """
    rows = _filled(rows)
    ship(rows.sparkSession)
    # One row for each cluster.
    m = _moments(rows).orderBy("cluster").collect()
    shared = rows.sparkSession.sparkContext.broadcast(([r.cluster for r in m], np.array([r.n for r in m], np.float64), np.array([r.q for r in m]), np.array([r.s for r in m], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n, q, s = shared.value
        place = {c: i for i, c in enumerate(names)}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(2).to_pylist(), np.float64)
            own = np.array([place[c] for c in batch.column(1).to_pylist()])
            mean = np.maximum((x * x).sum(1)[:, None] + (q - 2 * x @ s.T) / n, 0)
            at = np.arange(len(x)), own
            a = mean[at] * n[own] / np.maximum(n[own] - 1, 1)
            mean[at] = np.inf
            b = mean.min(1)
            known = (n[own] > 1) & np.isfinite(b) & (np.maximum(a, b) > 0)
            value = np.where(known, (np.where(known, b, 0) - a) / np.where(known, np.maximum(a, b), 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], ["series_id", "cluster", "silhouette"])

    return rows.select(F.col("series_id").cast("long").alias("series_id"), F.col("cluster").cast("int").alias("cluster"), "v").mapInArrow(run, "series_id bigint, cluster int, silhouette double")


def calinski_harabasz(rows: DataFrame) -> DataFrame:
    """(score): the scatter between clusters over k - 1, to that within them over n - k, of rows(cluster, v); null if undefined."""
    m = _moments(_filled(rows))
    points = m.select("n", F.posexplode("s").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("own"), (F.pow(F.sum("s"), F.lit(2)) / F.sum("n")).alias("whole"))
    sums = points.agg(F.sum("own").alias("own"), F.sum("whole").alias("whole"))
    sizes = m.agg(F.sum("q").alias("q"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    between, within = F.col("own") - F.col("whole"), F.col("q") - F.col("own")
    return sizes.join(sums).select(F.round(F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("n") - F.col("k"))), 6).alias("score"))
