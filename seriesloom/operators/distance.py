"""Least distances between candidates and the windows of series.

Few candidates are broadcast, many meet the series by pairs of bounded blocks, so that any number of them can be matched;
within a task numpy compares all windows of a batch of series with the candidates of one length at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import ship
from .blocks import every_pair, hashed_block, parts_by_rows, parts_of

#: Numbers in a table of windows that a task holds.
WINDOW_VALUES = 1 << 22
FIELDS = pa.schema([("cand_id", pa.int64()), ("series_id", pa.int64()), ("label", pa.int32()), ("dist", pa.float64()), ("pos", pa.int32())])


def window_ids(series: DataFrame, length: Column | str, start: Column | str) -> Column:
    """A number for each window of series(series_id, v): series_id, length and start, in fields that hold the longest series.

    Fields have three digits for series of under 1000 points, else as many as the longest one needs.
    """
    r = series.agg(F.max(F.size("v")).alias("longest"), F.min("series_id").cast("long").alias("least"), F.max("series_id").cast("long").alias("most")).first()
    base = max(1_000, 10 ** len(str(max(0, r.longest or 0))))
    if (max(abs(r.least or 0), abs(r.most or 0)) + 1) * base * base >= 1 << 63:
        raise ValueError(f"windows of series of {r.longest} points and series_id up to {r.most} can't be numbered in 64 bits")
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return (F.col("series_id").cast("long") * F.lit(base * base).cast("long") + col(length).cast("long") * base + col(start)).cast("long")


def candidates(series: DataFrame, lengths: range | tuple[int, ...], step: int = 1) -> DataFrame:
    """(cand_id, series_id, start_idx, length, values): windows of the lengths at every step-th start.

    cand_id numbers the windows (window_ids).
    """
    at = F.explode(F.array(*[F.lit(x) for x in lengths])).alias("length")
    rows = series.select("series_id", "v", at).where(F.size("v") >= F.col("length"))
    rows = rows.select("series_id", "v", "length", F.explode(F.sequence(F.lit(0), F.size("v") - F.col("length"), F.lit(step))).alias("start_idx"))
    cand = window_ids(series, "length", "start_idx")
    return rows.select(cand.alias("cand_id"), "series_id", "start_idx", "length", F.slice("v", F.col("start_idx") + 1, F.col("length")).alias("values"))


def _z(x: np.ndarray) -> np.ndarray:
    s = x.std(axis=-1, keepdims=True)
    return (x - x.mean(axis=-1, keepdims=True)) / np.where(s == 0, 1, s)


def _least(short: np.ndarray, long: np.ndarray, normalize: bool) -> tuple[np.ndarray, np.ndarray]:
    """For short (k, l) and long (n, m >= l): least squared distance and its first position, both (n, k)."""
    w = np.lib.stride_tricks.sliding_window_view(long, short.shape[1], axis=1)
    if normalize:
        short, w = _z(short), _z(w)
    square = (w * w).sum(-1)[:, :, None] + (short * short).sum(-1)[None, None, :] - 2 * (w @ short.T)
    square = np.maximum(square, 0)
    # Distances that agree to 9 digits are ties: the first position counts.
    near = square <= square.min(axis=1, keepdims=True) + 1e-9
    return square.min(axis=1), near.argmax(axis=1)


def min_distances(series: DataFrame, cands: DataFrame, normalize: bool = True, per_length: bool | None = None) -> DataFrame:
    """(cand_id, series_id, label, dist, pos) of every pair of cands(cand_id, values) and series(series_id, label, v).

    dist: least Euclidean distance to a window; normalize: of z-normed windows (flat ones are zeros).  per_length
    divides by the root of the length (by default if normalize).  If the series is the shorter, its windows and the
    candidate change places.  pos: the first best window.  Empty arrays give no row.

    Candidates of one block (BLOCK_VALUES numbers) are broadcast; more meet the series by pairs of blocks, in one plan of fixed size.  A
    stream of series has one pass for each block instead.
    """
    per_length = normalize if per_length is None else per_length
    spark = series.sparkSession
    ship(spark)
    schema = "cand_id bigint, series_id bigint, label int, dist double, pos int"
    mine = series.select(F.col("series_id").cast("long").alias("series_id"), F.col("label").cast("int").alias("label"), "v")
    theirs = cands.select(F.col("cand_id").cast("long").alias("cand_id"), "values")

    def block(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        by_length: dict[int, list[tuple[int, list[float]]]] = defaultdict(list)
        for cand, x in zip(table["cand_id"].to_pylist(), table["values"].to_pylist(), strict=True):
            by_length[len(x or ())].append((cand, x))
        return {n: (np.array([c for c, _ in xs]), np.array([x for _, x in xs], np.float64)) for n, xs in by_length.items() if n}

    def match(table: pa.Table | pa.RecordBatch, other: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[int]] = defaultdict(list)
        series_ids, labels, values = (table.column(i).to_pylist() for i in range(3))
        for i, v in enumerate(values):
            if v:
                groups[len(v)].append(i)
        for m, rows in groups.items():
            for length, (ids, x) in other.items():
                take = max(1, WINDOW_VALUES // (max(1, m - length + 1) * max(length, len(ids))))
                for at in range(0, len(rows), take):
                    part = rows[at : at + take]
                    own = np.array([values[i] for i in part], np.float64)
                    if length <= m:
                        best, pos = _least(x, own, normalize)
                    else:
                        best, pos = (y.T for y in _least(own, x, normalize))
                    dist = np.sqrt(best / (min(length, m) if per_length else 1))
                    k = len(ids)
                    who = [i for i in part for _ in range(k)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(part))), pa.array([series_ids[i] for i in who], pa.int64()), pa.array([labels[i] for i in who], pa.int32()), pa.array(dist.ravel()), pa.array(pos.ravel().astype(np.int32))], FIELDS.names)

    parts = parts_of(theirs, "values")
    if parts == 1 or series.isStreaming:
        out = None
        for i in range(parts):
            shared = spark.sparkContext.broadcast(block((theirs if parts == 1 else theirs.where(hashed_block("cand_id", parts) == i)).toArrow()))
            rows = mine.mapInArrow(lambda batches, shared=shared: (x for batch in batches for x in match(batch, shared.value)), schema)
            out = rows if out is None else out.unionAll(rows)
        return out

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(match(left, block(right))), FIELDS)

    least = parts_by_rows(mine.count(), theirs.count())
    return every_pair(mine, max(least, parts_of(mine)), "series_id", theirs, max(least, parts), "cand_id").applyInArrow(pair, schema)


def mean_square(series: DataFrame, cands: DataFrame) -> DataFrame:
    """(cand_id, series_id, label, dist): least mean squared difference, the distance of learned shapelets."""
    rows = min_distances(series, cands, normalize=False, per_length=True)
    return rows.select("cand_id", "series_id", "label", F.pow("dist", F.lit(2)).alias("dist"))


def min_distances_declarative(series: DataFrame, cands: DataFrame, length: int) -> DataFrame:
    """The z-normed least distance to candidates of one length, from built-in expressions alone: a check on the kernel."""
    w = series.select("series_id", "label", F.posexplode(A.windows(F.col("v"), length)).alias("pos", "w"))
    w = w.select("series_id", "label", "pos", A.z_norm(F.col("w")).alias("w"))
    c = cands.where(F.col("length") == length).select("cand_id", A.z_norm(F.col("values")).alias("c"))
    dist = F.round(A.norm_euclidean(F.col("w"), F.col("c")), 9)
    best = w.join(F.broadcast(c)).groupBy("cand_id", "series_id", "label").agg(F.min(F.struct(dist.alias("dist"), "pos")).alias("best"))
    return best.select("cand_id", "series_id", "label", "best.dist", "best.pos")


def features(dist: DataFrame) -> DataFrame:
    """(series_id, label, features): distances of each series in the order of cand_id."""
    rows = dist.groupBy("series_id", "label").agg(F.array_sort(F.collect_list(F.struct("cand_id", "dist"))).alias("d"))
    return rows.select("series_id", "label", F.transform("d", lambda x: x["dist"]).alias("features"))
