"""Nearest rows by brute force in blocks: a small other side is broadcast, a larger one meets the queries by pairs of blocks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from ..session import ship

BLOCK_VALUES = 1 << 21
#: Rows that a pair of blocks makes, at most about.
PAIR_ROWS = 1 << 22


def _euclid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


#: Rows and others whose products are held at once; pairs that are worked out at once; pairs for each row beyond which single precision is given up.
ROWS, OTHERS, PAIRS, LOOSE = 256, 2048, 1 << 15, 64


def _candidates(x: np.ndarray, y: np.ndarray, k: int, twins: tuple[np.ndarray, np.ndarray], kind: type) -> tuple[np.ndarray, np.ndarray] | None:
    """(row of x, row of y) of pairs that may be among the k nearest, from products in a precision; none if single precision leaves too many."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    far = yy.max()
    if kind is np.float32 and max(xx.max(), far) > 1e30:
        return None
    # Products give |y|^2 - 2xy; what they may lose, twice.
    left = np.concatenate((-2 * x, np.ones((len(x), 1))), axis=1).astype(kind)
    slack = 2 * (x.shape[1] + 16) * np.finfo(kind).eps * (2 * np.sqrt(xx * far) + far) + 1e-300
    # The k least of the minima of runs of others are of k others, so the k-th is no less than the k-th of all.
    run = max(1, min(64, OTHERS // (4 * k)))
    least, out, count = np.full((k, len(x)), np.inf), [], 0
    for at in range(0, len(y), OTHERS):
        part = y[at : at + OTHERS]
        square = np.concatenate((part, yy[at : at + OTHERS, None]), axis=1).astype(kind) @ left.T
        mine = (twins[1] >= at) & (twins[1] < at + len(part))
        square[twins[1][mine] - at, twins[0][mine]] = np.inf
        whole = len(part) // run * run
        minima = [least, square[:whole].reshape(-1, run, len(x)).min(axis=1), *([square[whole:].min(axis=0, keepdims=True)] if whole < len(part) else [])]
        least = np.partition(np.concatenate(minima), k - 1, axis=0)[:k]
        reach = (np.sqrt(np.maximum(least[-1] + xx + slack, 0)) + 2e-9) ** 2 - xx + slack
        reach = np.nextafter(reach.astype(kind), kind(np.inf))
        other, row = np.nonzero((square <= reach) & (square < np.inf))
        count += len(row)
        if kind is np.float32 and count > LOOSE * k * len(x):
            return None
        out.append((row, at + other))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def least(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, Euclidean distance to nine digits) of the k nearest rows of y to each of x, ties by ids; own: ids of x, which are not their own neighbours.

    Products, in single precision first, say which pairs may be among them; those are worked out by differences, so no digits are lost between rows that
    are close but far from zero.  Not finite rows take no part.
    """
    # Squares of larger values are not finite either.
    fine, usable = (np.flatnonzero((np.abs(v) < 1e150).all(1)) for v in (x, y))
    if not len(fine) or not len(usable):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # Of equal rows the first ones by id are enough.
    order = usable[np.argsort(ids[usable], kind="stable")]
    alike = np.ascontiguousarray(y[order]).view(np.dtype((np.void, y.shape[1] * 8))).ravel()
    group = np.unique(alike, return_inverse=True)[1]
    if group.max() + 1 < len(order):
        by = np.argsort(group, kind="stable")
        rank = np.arange(len(by)) - np.searchsorted(group[by], group[by])
        order = order[np.sort(by[rank < k + (own is not None)])]
    held, centre = y[order], y[order].mean(0)
    shifted, names = held - centre, ids[order]
    found = []
    for at in range(0, len(fine), ROWS):
        rows = fine[at : at + ROWS]
        a = x[rows] - centre
        twins = (np.zeros(0, np.int64),) * 2
        if own is not None:
            low, high = (np.searchsorted(names, own[rows], side) for side in ("left", "right"))
            n = high - low
            twins = np.repeat(np.arange(len(rows)), n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs = _candidates(a, shifted, k, twins, np.float32) or _candidates(a, shifted, k, twins, np.float64)
        row, other = pairs
        d = [np.sqrt(((x[rows[row[i : i + PAIRS]]] - held[other[i : i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(row), PAIRS)]
        d = np.round(np.concatenate(d), 9) if d else np.zeros(0)
        turn = np.lexsort((names[other], d, row))
        row, other, d = row[turn], other[turn], d[turn]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((rows[row[kept]], order[other[kept]], d[kept]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def dtw(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dynamic time warping of every row of x with every row of y: root of the least sum of squared differences, no band."""
    n, m = x.shape[1], y.shape[1]
    cost = np.full((len(x), len(y), m + 1), np.inf)
    cost[:, :, 0] = 0
    for i in range(n):
        new = np.full_like(cost, np.inf)
        for j in range(m):
            d = (x[:, i, None] - y[None, :, j]) ** 2
            new[:, :, j + 1] = d + np.minimum(np.minimum(cost[:, :, j + 1], new[:, :, j]), cost[:, :, j])
        cost = new
    return np.sqrt(cost[:, :, m])


def dtw_bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """No more than dtw(x, y): what the points of one outside the other's range must cost at least, either way round, and the ends."""
    def outside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = b.min(1), b.max(1)
        return np.stack([(np.maximum(np.maximum(a - h, w - a), 0) ** 2).sum(1) for w, h in zip(low, high, strict=True)], axis=1)

    first = (x[:, None, 0] - y[None, :, 0]) ** 2
    last = (x[:, None, -1] - y[None, :, -1]) ** 2
    ends = first + last if x.shape[1] > 1 or y.shape[1] > 1 else first
    return np.sqrt(np.maximum(np.maximum(outside(x, y), outside(y, x).T), ends))


def dtw_pairs(x: np.ndarray, y: np.ndarray, within: np.ndarray) -> np.ndarray:
    """dtw of row i of x with row i of y; infinite where it is over within[i], as soon as a row of costs shows it."""
    n, m = x.shape[1], y.shape[1]
    out = np.full(len(x), np.inf)
    live = np.arange(len(x))
    cost = np.full((len(x), m + 1), np.inf)
    cost[:, 0] = 0
    for i in range(n):
        new = np.full_like(cost, np.inf)
        square = (x[live, i, None] - y[live]) ** 2
        for j in range(m):
            new[:, j + 1] = square[:, j] + np.minimum(np.minimum(cost[:, j + 1], new[:, j]), cost[:, j])
        keep = new.min(1) <= within[live] ** 2 * (1 + 1e-9) + 1e-9
        live, cost = live[keep], new[keep]
    out[live] = np.sqrt(cost[:, m])
    return out


#: Partners that the filter lets through at once for each row.
VERIFIED = 16


def dtw_filtered(x: np.ndarray, y: np.ndarray, k: int, same: np.ndarray | None) -> tuple[np.ndarray, int]:
    """(dtw of x with y where it may be among the k least of a row, else infinite; pairs that were worked out).

    Partners come by their bound; once the k-th distance of a row is under the next bound the rest is left out.  same: pairs to leave out.
    """
    bound = dtw_bound(x, y)
    if same is not None:
        bound[same] = np.inf
    order = np.argsort(bound, axis=1, kind="stable")
    out = np.full(bound.shape, np.inf)
    kth, count = np.full(len(x), np.inf), 0
    for at in range(0, y.shape[0], VERIFIED):
        some = order[:, at : at + VERIFIED]
        near = np.take_along_axis(bound, some, 1)
        row, place = np.nonzero(np.isfinite(near) & (near <= kth[:, None] + 1e-9))
        if not len(row):
            break
        column = some[row, place]
        out[row, column] = dtw_pairs(x[row], y[column], kth[row])
        count += len(row)
        if len(y) >= k:
            kth = np.partition(out, k - 1, axis=1)[:, k - 1]
    return out, count


def hashed_block(key: str, parts: int) -> Column:
    """The block, of ``parts``, that a row is in."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def every_pair(left: DataFrame, left_parts: int, left_key: str, right: DataFrame, right_parts: int, right_key: str) -> PandasCogroupedOps:
    """Both sides by pairs of blocks, each of a bounded size, ready for ``applyInArrow``: each row goes to all blocks of the other side by a shuffle."""
    every = lambda n: F.explode(F.array(*[F.lit(i) for i in range(n)])) if n <= 64 else F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = left.select("*", hashed_block(left_key, left_parts).alias("left_block"), every(right_parts).alias("right_block"))
    two = right.select("*", hashed_block(right_key, right_parts).alias("right_block"), every(left_parts).alias("left_block"))
    return one.groupBy("left_block", "right_block").cogroup(two.groupBy("left_block", "right_block"))


def parts_of(rows: DataFrame, values: str = "v") -> int:
    """Blocks of about BLOCK_VALUES numbers that rows make."""
    return max(1, -(-(rows.agg(F.sum(F.size(values))).first()[0] or 0) // BLOCK_VALUES))


def parts_by_rows(one: int, two: int) -> int:
    """Blocks of each side so that a pair of them makes about PAIR_ROWS of one * two rows."""
    return max(1, math.ceil(math.sqrt(one * two / PAIR_ROWS)))


def nearest(rows: DataFrame, others: DataFrame, k: int, same: bool, distance: Callable[[np.ndarray, np.ndarray], np.ndarray] = _euclid) -> DataFrame:
    """(series_id, label, other_id, other_label, dist, place): for each of rows(series_id, label, v) its k nearest of others.

    Euclidean distances are between arrays of one length; dtw takes any, and works out only the pairs that a lower bound lets through.
    Null and empty arrays take no part.  Others of one block (BLOCK_VALUES numbers) are broadcast; more meet the rows by pairs of blocks.
    """
    ship(rows.sparkSession)
    mine = rows.select(F.col("series_id").cast("long").alias("series_id"), F.col("label").cast("int").alias("label"), "v")
    # Names of their own: the two sides may be one table, whose columns a cogroup would take for one.
    theirs = others.select(F.col("series_id").cast("long").alias("to_id"), F.col("label").cast("int").alias("to_label"), F.col("v").alias("to_v"))
    schema = "series_id bigint, label int, other_id bigint, other_label int, dist double"

    mine, theirs = mine.where(F.size("v") > 0), theirs.where(F.size("to_v") > 0)

    def groups(table: pa.Table | pa.RecordBatch, prefix: str = "") -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """ids, labels and values of the rows of each length, by id."""
        table = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
        ids, labels, values = (f"{prefix}{c}" for c in (("id", "label", "v") if prefix else ("series_id", "label", "v")))
        table = table.take(pa.array(np.argsort(table[ids].to_numpy(), kind="stable")))
        lengths = pc.list_value_length(table[values]).to_numpy()
        for n in np.unique(lengths):
            part = table.filter(pa.array(lengths == n))
            yield part[ids].to_numpy(), part[labels].combine_chunks(), part[values].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)

    def block(table: pa.Table) -> list[tuple[np.ndarray, pa.Array, np.ndarray]]:
        return list(groups(table, "to_"))

    def match(table: pa.Table | pa.RecordBatch, others: list[tuple[np.ndarray, pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for (own_ids, own_labels, x), (ids, labels, y) in itertools.product(groups(table), others):
            if distance is _euclid and x.shape[1] != y.shape[1]:
                continue
            if distance is _euclid:
                own, to, d = least(x, y, ids, k, own_ids if same else None)
                yield pa.RecordBatch.from_arrays([pa.array(own_ids[own]), own_labels.take(pa.array(own)), pa.array(ids[to]), labels.take(pa.array(to)), pa.array(d)], ["series_id", "label", "other_id", "other_label", "dist"])
                continue
            for at in range(0, len(x), 256):
                mates = own_ids[at : at + 256, None] == ids[None, :] if same else None
                if distance is dtw:
                    d = np.round(dtw_filtered(x[at : at + 256], y, k, mates)[0], 9)
                else:
                    d = np.round(distance(x[at : at + 256], y), 9)
                    if same:
                        d[mates] = np.inf
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(d, best, 1)
                keep = np.flatnonzero(np.isfinite(value).ravel())
                own = at + np.repeat(np.arange(len(d)), best.shape[1])[keep]
                to = best.ravel()[keep]
                yield pa.RecordBatch.from_arrays([pa.array(own_ids[own]), own_labels.take(pa.array(own)), pa.array(ids[to]), labels.take(pa.array(to)), pa.array(value.ravel()[keep])], ["series_id", "label", "other_id", "other_label", "dist"])

    parts = parts_of(theirs, "to_v")
    if parts == 1:
        table = theirs.toArrow()
        if not table.num_rows:
            return rows.sparkSession.createDataFrame([], schema + ", place int")
        shared = rows.sparkSession.sparkContext.broadcast(block(table))
        out = mine.mapInArrow(lambda batches: (x for batch in batches for x in match(batch, shared.value)), schema)
    else:
        empty = pa.schema([("series_id", pa.int64()), ("label", pa.int32()), ("other_id", pa.int64()), ("other_label", pa.int32()), ("dist", pa.float64())])

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            found = match(left, block(right)) if left.num_rows and right.num_rows else []
            return pa.Table.from_batches([x.cast(empty) for x in found], empty)

        out = every_pair(mine, parts_of(mine), "series_id", theirs, parts, "to_id").applyInArrow(pair, schema)
    place = F.row_number().over(Window.partitionBy("series_id").orderBy("dist", "other_id"))
    return out.withColumn("place", place).where(F.col("place") <= k)
