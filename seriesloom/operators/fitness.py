"""Fitness of many sets of shapelets at once: cross-validated logistic regressions on their distances.

All sets and folds are fitted together by Newton steps.  A step is one job: tasks add up gradient, curvature and loss of every (set, fold) over
their series, the shuffle adds the tasks' sums, and the driver solves one small system for each model.  A step that raises a model's loss is halved.
A set of f shapelets and c classes has (f + 1) * c weights; the sums of all models go to the driver, so sets are meant to be small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..tables import store
from .distance import min_distances

#: Steps end when no model's loss falls by more than SETTLED (for each row), or after as many as STEPS, which a convex loss doesn't need.
SETTLED, STEPS = 1e-9, 60
#: Rows that a task looks at together.
ROWS = 1024


def feature_rows(series: DataFrame, sets: Sequence[Sequence[np.ndarray]], folds: int, seed: int) -> DataFrame:
    """(label, fold, d): raw least distances of each series to all arrays of all sets, in order; stored.  Series without a value or a label are left out."""
    schema = "cand_id bigint, values array<double>"
    flat = [(i, [float(y) for y in x]) for i, x in enumerate(x for s in sets for x in s)]
    series = series.where("label IS NOT NULL")
    rows = min_distances(series, series.sparkSession.createDataFrame(flat, schema), False)
    rows = rows.groupBy("series_id", "label").agg(F.array_sort(F.collect_list(F.struct("cand_id", "dist"))).alias("d"))
    fold = F.pmod(F.xxhash64("series_id", F.lit(seed)), F.lit(folds)).cast("int")
    return store(rows.select("label", fold.alias("fold"), F.transform("d", lambda x: x["dist"]).alias("d")), "fitness-rows")


def _softmax(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Probabilities of rows x under the weights w(..., features + 1, classes); the last feature is 1."""
    logits = x @ w
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    return p / p.sum(-1, keepdims=True)


def _sums(rows: DataFrame, spans: list[tuple[int, int]], labels: list[int], folds: int, weights: list[np.ndarray], held_out: bool) -> list[np.ndarray]:
    """For each set and fold, in order: loss, rows, gradient and curvature over the rows outside the fold; held_out: loss and rows of those in it."""
    shared = rows.sparkSession.sparkContext.broadcast((spans, weights, {c: i for i, c in enumerate(labels)}))
    classes = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, weights, code = shared.value
        total = [[None] * folds for _ in spans]
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            y = np.array([code[c] for c in batch.column(0).to_pylist()])
            fold = batch.column(1).to_numpy()
            d = np.asarray(batch.column(2).flatten()).reshape(len(y), -1)
            for s, (a, b) in enumerate(spans):
                x = np.column_stack((d[:, a:b], np.ones(len(y))))
                for f in range(folds):
                    part = fold == f if held_out else fold != f
                    own, right = x[part], y[part]
                    p = _softmax(own, weights[s][f])
                    loss = -np.log(np.maximum(p[np.arange(len(own)), right], 1e-300)).sum()
                    if held_out:
                        found = np.array([loss, len(own)])
                    else:
                        gap = p.copy()
                        gap[np.arange(len(own)), right] -= 1
                        curve = -np.einsum("nc,nk,ni,nj->icjk", p, p, own, own, optimize=True)
                        diagonal = np.einsum("nc,ni,nj->icj", p, own, own, optimize=True)
                        curve[:, range(classes), :, range(classes)] += diagonal.transpose(1, 0, 2)
                        found = np.concatenate(([loss, len(own)], (own.T @ gap).ravel(), curve.ravel()))
                    total[s][f] = found if total[s][f] is None else total[s][f] + found
        for s, of in enumerate(total):
            if of[0] is not None:
                yield pa.RecordBatch.from_arrays([pa.array([s * folds + f for f in range(folds)], pa.int32()), pa.array([t.tobytes() for t in of], pa.binary())], ["model", "sums"])

    def added(group: pa.Table) -> pa.Table:
        whole = np.sum([np.frombuffer(b) for b in group["sums"].to_pylist()], axis=0)
        return pa.table([group["model"][:1], pa.array([whole.tobytes()], pa.binary())], names=["model", "sums"])

    ddl = "model int, sums binary"
    found = rows.mapInArrow(run, ddl).groupBy("model").applyInArrow(added, ddl).toArrow().sort_by("model")
    return [np.frombuffer(b) for b in found["sums"].to_pylist()]


def logistic_losses(series: DataFrame, sets: Sequence[Sequence[np.ndarray]], folds: int = 3, seed: int = 1337, strength: float = 1.0) -> list[float]:
    """For each set of arrays the mean log-loss of held-out series(series_id, label, v) under logistic regressions on their raw least distances.

    The regression minimizes the sum of losses plus half the squared weights over ``strength`` (intercepts are free).  Folds come from a hash of
    series_id.  No series, or one class: infinite.
    """
    ship(series.sparkSession)
    sets = [list(s) for s in sets]
    rows = feature_rows(series, sets, folds, seed)
    labels = [r.label for r in rows.select("label").distinct().orderBy("label").collect()]
    c = len(labels)
    if c < 2:
        return [float("inf")] * len(sets)
    ends = np.cumsum([0, *map(len, sets)]).tolist()
    spans = list(zip(ends[:-1], ends[1:], strict=True))
    weights = [np.zeros((folds, len(s) + 1, c)) for s in sets]
    best = [np.full(folds, np.inf) for _ in sets]
    kept = [w.copy() for w in weights]
    step = [np.zeros_like(w) for w in weights]
    live = True
    for _ in range(STEPS):
        if not live:
            break
        live = False
        sums = _sums(rows, spans, labels, folds, weights, False)
        for s, shapes in enumerate(sets):
            n = len(shapes) + 1
            free = np.ones((n, c))
            free[-1] = 0
            for f in range(folds):
                loss, count, rest = sums[s * folds + f][0], sums[s * folds + f][1], sums[s * folds + f][2:]
                w = weights[s][f]
                whole = loss + (free * w * w).sum() / (2 * strength)
                if not whole <= best[s][f]:
                    # Too far: halve the step from the best weights so far.
                    step[s][f] /= 2
                    weights[s][f] = kept[s][f] + step[s][f]
                    live |= np.abs(step[s][f]).max() > 1e-12
                    continue
                fell = best[s][f] - whole
                best[s][f], kept[s][f] = whole, w.copy()
                if fell <= SETTLED * max(1.0, count):
                    step[s][f] = 0
                    continue
                gradient = rest[: n * c] + (free * w).ravel() / strength
                # A common shift of the intercepts changes nothing: a trace of curvature keeps the system regular.
                curve = rest[n * c :].reshape(n * c, n * c) + np.diag(free.ravel() / strength + (1 - free.ravel()) * 1e-9 * max(1.0, count))
                step[s][f] = -np.linalg.solve(curve, gradient).reshape(n, c)
                weights[s][f] = w + step[s][f]
                live = True
    sums = np.array(_sums(rows, spans, labels, folds, kept, True)).reshape(len(sets), folds, 2).sum(1)
    return (sums[:, 0] / sums[:, 1]).tolist()
