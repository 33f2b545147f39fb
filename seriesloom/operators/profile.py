"""Matrix profiles: the nearest other window of every window of a sequence, in one or more dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query windows that a task compares at once.
QUERIES = 128
_EPS = 1e-7


def matrix_profile(sequences: DataFrame, length: int, spread: int = 1, digits: int = 9) -> DataFrame:
    """(seq_id, k, pos, profile, nearest, dims) of sequences(seq_id, v array<array<double>>: one array per dimension).

    For each window and k (from 1): the root of the mean of the k least squared z-normed distances over dimensions, at
    the best other start outside [pos - length/2, pos + length/2) (null if there is none), and those dimensions.
    Values that are not finite count as 0 and their windows are left out; constant targets are left out.  Distances
    that agree to ``digits`` are ties: the smallest start counts.  ``spread`` tasks share the queries of one sequence.
    """
    if length < 4:
        raise ValueError("windows must have 4 points")
    queries = sequences.select("seq_id", "v", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"))
    if spread > 1:
        queries = queries.repartition("seq_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, v, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.array([[np.nan if e is None else e for e in d] for d in v], np.float64)
                if x.ndim != 2 or x.shape[1] < length:
                    continue
                bad = ~np.isfinite(x)
                w = np.lib.stride_tricks.sliding_window_view(np.where(bad, 0, x), length, axis=1)
                skip = np.lib.stride_tricks.sliding_window_view(bad, length, axis=1).any(-1).any(0)
                n = w.shape[1]
                sd = w.std(-1)
                z = (w - w.mean(-1, keepdims=True)) / np.maximum(sd, _EPS)[..., None]
                out: dict[str, list] = {c: [] for c in ("seq_id", "k", "pos", "profile", "nearest", "dims")}
                own = np.arange(n)[part::spread]
                for at in range(0, len(own), QUERIES):
                    q = own[at : at + QUERIES]
                    d = np.maximum(2 * (length - np.einsum("dql,dtl->dqt", z[:, q], z)), 0)
                    d[:, :, skip] = np.inf
                    d = np.where((sd < _EPS)[:, None, :], np.inf, d)
                    gap = np.arange(n)[None, :] - q[:, None]
                    d[:, (gap >= -(length // 2)) & (gap < length // 2)] = np.inf
                    order = np.argsort(d, axis=0, kind="stable")
                    best = np.cumsum(np.take_along_axis(d, order, 0), axis=0) / np.arange(1, len(d) + 1)[:, None, None]
                    best = np.sqrt(best)
                    where = np.round(best, digits).argmin(axis=2)
                    for k in range(len(d)):
                        for i, p in enumerate(q):
                            value = best[k, i, where[k, i]]
                            real = np.isfinite(value) and not skip[p]
                            for c, y in (("seq_id", seq), ("k", k + 1), ("pos", int(p)), ("profile", float(value) if real else None), ("nearest", int(where[k, i]) if real else None), ("dims", sorted(order[: k + 1, i, where[k, i]].tolist()) if real else None)):
                                out[c].append(y)
                types = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(y, t) for y, t in zip(out.values(), types, strict=True)], list(out))

    return queries.select(F.col("seq_id").cast("long").alias("seq_id"), "v", "part").mapInArrow(run, "seq_id bigint, k int, pos int, profile double, nearest int, dims array<int>")


def motifs(profile: DataFrame, largest: bool = False) -> DataFrame:
    """(seq_id, k, pos, profile, nearest): the window with the smallest profile (a motif) or the largest (a discord); ties: the first."""
    value = F.round("profile", 6)
    order = Window.partitionBy("seq_id", "k").orderBy(value.desc() if largest else value, "pos")
    return profile.where("profile IS NOT NULL").withColumn("place", F.row_number().over(order)).where("place = 1").select("seq_id", "k", "pos", "profile", "nearest")
