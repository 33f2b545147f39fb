"""Clusters of series, or of a population of arrays, by the global alignment kernel; lengths may differ."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..tables import store
from .alignment import sigma

#: Pairs whose tables of sums a task holds at once.
PAIRS = 1 << 14
#: Most landmarks; they are broadcast.
LANDMARKS = 256


def log_kernels(x: np.ndarray, y: np.ndarray, width: float) -> np.ndarray:
    """Logarithm of the alignment kernel of row i of x with row i of y, as ``alignment.log_kernel`` for all rows at once."""
    before = np.full((len(x), y.shape[1] + 1), -np.inf)
    before[:, 0] = 0
    for i in range(x.shape[1]):
        local = -((x[:, i, None] - y) ** 2) / (2 * width * width)
        local -= np.log(2 - np.exp(local))
        now = np.full_like(before, -np.inf)
        for j in range(y.shape[1]):
            now[:, j + 1] = local[:, j] + np.logaddexp(np.logaddexp(before[:, j], before[:, j + 1]), now[:, j])
        before = now
    return before[:, -1]


def _alike(arrays: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of the arrays of each length."""
    lengths = np.array([len(x) for x in arrays])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.array([arrays[i] for i in at], np.float64)


def own_kernels(arrays: Sequence[np.ndarray], width: float) -> np.ndarray:
    """Logarithm of the kernel of each array with itself."""
    out = np.zeros(len(arrays))
    for at, x in _alike(arrays):
        for part in range(0, len(at), PAIRS):
            out[at[part : part + PAIRS]] = log_kernels(x[part : part + PAIRS], x[part : part + PAIRS], width)
    return out


def kernels(xs: Sequence[np.ndarray], ys: Sequence[np.ndarray], width: float, own_y: np.ndarray | None = None) -> np.ndarray:
    """Kernel of each of xs with each of ys, scaled so that equal arrays have 1."""
    own_x, own_y = own_kernels(xs, width), own_kernels(ys, width) if own_y is None else own_y
    out = np.zeros((len(xs), len(ys)))
    others = list(_alike(ys))
    for at, x in _alike(xs):
        for to, y in others:
            step = max(1, PAIRS // len(y))
            for part in range(0, len(x), step):
                some = x[part : part + step]
                pairs = log_kernels(np.repeat(some, len(y), axis=0), np.tile(y, (len(some), 1)), width)
                out[np.ix_(at[part : part + step], to)] = pairs.reshape(len(some), len(y))
    return np.exp(out - (own_x[:, None] + own_y[None, :]) / 2)


def root(gram: np.ndarray) -> np.ndarray:
    """R with gram @ R as coordinates whose inner products are the kernel; directions without weight are left out."""
    values, vectors = np.linalg.eigh(gram)
    kept = values > 1e-10 * max(values.max(), 1e-300)
    return vectors[:, kept] / np.sqrt(values[kept])


def spread_starts(features: np.ndarray, k: int) -> np.ndarray:
    """k starts: the first row, then always the row that is farthest from those taken, ties to the first; no row twice."""
    taken = [0]
    far = ((features - features[0]) ** 2).sum(1)
    while len(taken) < k and far.max() > 1e-12:
        taken.append(int(np.round(far, 9).argmax()))
        far = np.minimum(far, ((features - features[taken[-1]]) ** 2).sum(1))
    return features[taken].copy()


def closest(features: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, squared distance), ties to the smaller centre."""
    d = np.round(np.column_stack([((features - c) ** 2).sum(1) for c in centres]), 9)
    best = d.argmin(1)
    return best, d[np.arange(len(d)), best]


@dataclass
class KernelKMeans:
    """Lloyd steps in the space of the alignment kernel, over any number of series.

    Series get coordinates from their kernel with a bounded sample of landmarks (in the order of a hash, LANDMARKS at most), so the work grows
    with the series, not with pairs; where all different series are landmarks the clusters are those of the full kernel matrix.  Starts
    are landmarks far from each other.  A step is one job that adds up sums by centre.  Null, empty and non-finite arrays take no part.
    """

    k: int = 3
    rounds: int = 10
    landmarks: int = 64
    seed: int = 1337
    width: float = 0.0
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    inertia: list[float] = field(default_factory=list)
    marks: list[np.ndarray] = field(default_factory=list, repr=False)

    @staticmethod
    def _usable(series: DataFrame) -> DataFrame:
        v = F.col("v").cast("array<double>")
        kept = series.where((F.size("v") > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
        return kept.select(F.col("series_id").cast("long").alias("series_id"), v.alias("v"))

    def fit(self, series: DataFrame) -> KernelKMeans:
        ship(series.sparkSession)
        rows = self._usable(series)
        drawn = rows.orderBy(F.xxhash64("v", F.lit(self.seed)), "v").limit(min(self.landmarks, LANDMARKS)).select("v").collect()
        self.marks = [np.array(v) for v in dict.fromkeys(tuple(r.v) for r in drawn)]
        self.inertia, self.centres = [], np.zeros((0, 0))
        if not self.marks:
            return self
        self.width = sigma(self.marks)
        gram = kernels(self.marks, self.marks, self.width)
        self._root, self._own = root(gram), own_kernels(self.marks, self.width)
        self.centres = spread_starts(gram @ self._root, self.k)
        found = store(self._features(rows), "kernel-features")
        for _ in range(self.rounds):
            # One row for each centre and coordinate.
            sums = self._sums(found).groupBy("centre", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
            moved = self.centres.copy()
            for r in sums:
                if r.at >= 0:
                    moved[r.centre, r.at] = r.total / r.n
            self.inertia.append(sum(r.total for r in sums if r.at < 0))
            still = np.allclose(moved, self.centres, rtol=0, atol=1e-12)
            self.centres = moved
            if still:
                break
        return self

    def _features(self, rows: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((self.marks, self._own, self._root, self.width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks, own, base, width = shared.value
            for batch in batches:
                if batch.num_rows:
                    f = kernels([np.array(v) for v in batch.column(1).to_pylist()], marks, width, own) @ base
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(f))], ["series_id", "f"])

        return rows.mapInArrow(run, "series_id bigint, f array<double>")

    def _sums(self, features: DataFrame) -> DataFrame:
        shared = features.sparkSession.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            k, n = centres.shape
            total, count, inertia = np.zeros((k, n)), np.zeros(k, np.int64), np.zeros(k)
            for batch in batches:
                if batch.num_rows:
                    f = np.array(batch.column(0).to_pylist())
                    best, d = closest(f, centres)
                    np.add.at(total, best, f)
                    np.add.at(inertia, best, d)
                    count += np.bincount(best, minlength=k)
            # Coordinate -1 has the squared distances.
            values = np.column_stack((inertia, total))[count > 0]
            at = np.tile(np.arange(-1, n, dtype=np.int32), len(values))
            centre = np.repeat(np.flatnonzero(count).astype(np.int32), n + 1)
            yield pa.RecordBatch.from_arrays([pa.array(centre), pa.array(at), pa.array(values.ravel()), pa.array(count[centre])], ["centre", "at", "total", "n"])

        return features.select("f").mapInArrow(run, "centre int, at int, total double, n bigint")

    def predict(self, series: DataFrame) -> DataFrame:
        """(series_id, cluster, dist): the centre and the squared distance in the kernel's space, of every series that takes part."""
        ship(series.sparkSession)
        if not self.marks:
            return series.sparkSession.createDataFrame([], "series_id bigint, cluster int, dist double")
        shared = series.sparkSession.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    best, d = closest(np.array(batch.column(1).to_pylist()), shared.value)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(d)], ["series_id", "cluster", "dist"])

        return self._features(self._usable(series)).mapInArrow(run, "series_id bigint, cluster int, dist double")


def gram_of(spark: SparkSession, arrays: Sequence[np.ndarray], width: float) -> np.ndarray:
    """Scaled kernel of every pair of a population of arrays: tasks work out rows of the matrix, which is as large as the population squared."""
    ship(spark)
    shared = spark.sparkContext.broadcast((list(arrays), own_kernels(arrays, width), width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, own, width = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                k = kernels([arrays[i]], arrays[: i + 1], width, own[: i + 1])[0]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([k])], ["i", "k"])

    out = np.zeros((len(arrays), len(arrays)))
    # Rows grow with i, so near ones are dealt to different tasks.
    for r in spark.range(len(arrays)).repartition(spark.sparkContext.defaultParallelism, "id").mapInArrow(run, "i bigint, k array<double>").collect():
        out[r.i, : r.i + 1] = out[: r.i + 1, r.i] = r.k
    return out


def silhouette(square: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette for a table of distances; a row alone in its cluster has 0."""
    member = labels[:, None] == np.unique(labels)[None, :]
    size, own = member.sum(0), member.argmax(1)
    at = np.arange(len(labels)), own
    mean = square @ member / size
    a = mean[at] * size[own] / np.maximum(size[own] - 1, 1)
    mean[at] = np.inf
    b = mean.min(1)
    known = (size[own] > 1) & np.isfinite(b) & (np.maximum(a, b) > 0)
    return float((np.where(known, b, 0) - np.where(known, a, 0)).dot(1 / np.where(known, np.maximum(a, b), 1)) / len(labels))


def grouped(spark: SparkSession, arrays: Sequence[np.ndarray], rounds: int = 10) -> np.ndarray:
    """Clusters of a population of arrays by the kernel: of 2 to the root of their number, the count with the best silhouette."""
    if len(arrays) < 3:
        return np.zeros(len(arrays), np.int64)
    gram = gram_of(spark, arrays, sigma(arrays))
    features, square = gram @ root(gram), np.maximum(2 - 2 * gram, 0)
    best, chosen = -np.inf, np.zeros(len(arrays), np.int64)
    for k in range(2, math.ceil(math.sqrt(len(arrays))) + 1):
        centres = spread_starts(features, k)
        for _ in range(rounds):
            labels, _ = closest(features, centres)
            centres = np.array([features[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(len(centres))])
        labels, _ = closest(features, centres)
        score = silhouette(square, labels)
        if score > best:
            best, chosen = score, labels
    return chosen
