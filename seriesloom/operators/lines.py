"""Gains of many candidates without a row for each distance.

Series of a bounded size (HELD numbers) are broadcast; a task takes some candidates at a time, works out their distances to all series and scores the
whole order lines, so that only the best cut of a line leaves it.  Lines are rounded as ``metrics.order_line`` rounds them: a distance is a whole number of
ticks, a point is a tick and a class in one number, and sorted numbers give the running counts of all classes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .distance import _least, _z

#: Numbers of series that are broadcast at most, and numbers of windows that a task keeps.
HELD = 1 << 23
#: Distances under which rows and SQL do as well.
ROWS = 1 << 18
#: Distances that a task holds, windows of a block of series, points that are scored at once, distances of a task about.
LINES, CELLS, SCORED, TASK = 1 << 21, 1 << 18, 1 << 18, 1 << 26
#: Digits of an order line.
TICKS = 1e5

FOUND = "cand_id bigint, score double, gap double, tau double"
_FOUND = ["cand_id", "score", "gap", "tau"]


def _sound(c: str):
    return F.coalesce(F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(True))


def parts(series: DataFrame, cands: DataFrame, values: str = "values", each: int = 1) -> int:
    """Tasks for the lines of cands (each row makes ``each`` of them), or 0 where rows and SQL are the way: few lines, series beyond HELD, null labels, null or not finite values."""
    facts = series.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v")).alias("points"), F.min(_sound("v") & F.col("label").isNotNull()).alias("sound")).first()
    if not facts.n or not facts.sound or (facts.points or 0) > HELD:
        return 0
    own = cands.agg(F.count(F.lit(1)).alias("n"), F.min(_sound(values)).alias("sound")).first()
    rows = own.n * each * facts.n
    return max(3 * series.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK)) if rows > ROWS and own.sound else 0


def best_cuts(dist: np.ndarray, codes: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, gain, gap, tau) of the best cut of every line of dist(lines, series) that has one: what ``order_lines.GAIN`` gives, to nine digits."""
    n = dist.shape[1]
    none = (np.zeros(0, np.int64), *(np.zeros(0),) * 3)
    if n < 2:
        return none
    bits = max(1, int(classes - 1).bit_length())
    table = np.arange(n + 1) * np.log(np.maximum(np.arange(n + 1), 1))
    sizes = np.bincount(codes, minlength=classes)
    whole = np.log(n) - table[sizes].sum() / n
    at = np.arange(1, n)
    out = []
    step = max(1, SCORED // n)
    for first in range(0, len(dist), step):
        ticks = np.floor(dist[first : first + step] * TICKS + 0.5)
        narrow = ticks.size == 0 or ticks.max() < 1 << (31 - bits)
        points = ticks.astype(np.int32 if narrow else np.int64)
        points <<= bits
        points |= codes.astype(points.dtype)
        points.sort(axis=1)
        ticks = points >> bits
        kinds = points & ((1 << bits) - 1)
        inside = np.zeros((len(points), n - 1))
        counted = None
        for c in range(classes):
            if c == classes - 1 and counted is not None:
                left = at - counted
            else:
                left = np.cumsum(kinds[:, :-1] == c, axis=1, dtype=np.int32)
                counted = left if counted is None else counted + left
            inside += table[left]
            inside += table[sizes[c] - left]
        gain = whole - (table[at] + table[n - at] - inside) / n
        gain[ticks[:, 1:] == ticks[:, :-1]] = -np.inf
        line, cut = np.nonzero((gain >= gain.max(axis=1, keepdims=True) - 1.1e-9) & np.isfinite(gain))
        if not len(line):
            continue
        sums = np.cumsum(ticks, axis=1, dtype=np.int64)
        near = sums[line, cut] / TICKS
        total = sums[line, -1] / TICKS
        gains = np.round(gain[line, cut], 9)
        gaps = np.round((total - near) / (n - 1 - cut) - near / (cut + 1), 9)
        taus = (ticks[line, cut].astype(np.int64) + ticks[line, cut + 1]) / (2 * TICKS)
        order = np.lexsort((taus, -gaps, -gains, line))
        best = order[np.diff(line[order], prepend=-1) > 0]
        out.append((line[best] + first, gains[best], gaps[best], taus[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none


class _Held:
    """Series of one group by length, with labels as codes; the windows of a length are kept where they are few."""

    def __init__(self, labels: np.ndarray, values: list[np.ndarray]):
        known, codes = np.unique(labels, return_inverse=True)
        self.classes = len(known)
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, v in enumerate(values):
            if len(v):
                by_length[len(v)].append(i)
        self.tables = [np.array([values[i] for i in rows], np.float64) for rows in by_length.values()]
        self.codes = np.concatenate([codes[rows] for rows in by_length.values()]) if by_length else np.zeros(0, np.int64)
        self.n = len(self.codes)
        self._kept: dict[tuple[int, bool], list[list[np.ndarray]]] = {}

    def blocks(self, length: int, normalize: bool) -> Iterator[tuple[int, np.ndarray, int]]:
        """(rows before, windows and their squared norms (rows * starts, length + 1) or the rows themselves if they are shorter, starts or 0)."""
        key = (length, normalize)
        if key in self._kept:
            yield from self._kept[key]
            return
        size = sum(max(0, x.shape[1] - length + 1) * len(x) * (length + 1) for x in self.tables)
        made, before = [], 0
        for x in self.tables:
            starts = x.shape[1] - length + 1
            step = max(1, CELLS // (max(1, starts) * (length + 1)))
            for at in range(0, len(x), step):
                own = x[at : at + step]
                if starts > 0:
                    w = np.lib.stride_tricks.sliding_window_view(own, length, axis=1)
                    w = _z(w) if normalize else w
                    own = np.concatenate((w, (w * w).sum(-1, keepdims=True)), axis=2).reshape(-1, length + 1)
                block = (before + at, own, max(0, starts))
                if size <= HELD:
                    made.append(block)
                yield block
            before += len(x)
        if size <= HELD:
            self._kept = {key: made}

    def distances(self, cands: np.ndarray, normalize: bool, per_length: bool) -> np.ndarray:
        """(candidates, series), as min_distances gives them."""
        length = cands.shape[1]
        out = np.empty((len(cands), self.n))
        z = _z(cands) if normalize else cands
        sides = np.concatenate((-2 * z, np.ones((len(z), 1))), axis=1).T
        norms = (z * z).sum(1)
        for before, block, starts in self.blocks(length, normalize):
            if starts:
                n = len(block) // starts
                for at in range(0, n, step := max(1, CELLS // (starts * len(cands)))):
                    part = block[at * starts : (at + step) * starts] @ sides
                    square = part.reshape(-1, starts, len(cands)).min(axis=1) + norms
                    out[:, before + at : before + at + len(square)] = (square / (length if per_length else 1)).T
            else:
                out[:, before : before + len(block)] = _least(block, cands, normalize)[0] / (block.shape[1] if per_length else 1)
        return np.sqrt(np.maximum(out, 0, out=out), out=out)


def _hold(series: DataFrame, by: str | None) -> dict:
    table = series.select("label", "v", *([by] if by else [])).where(F.size("v") > 0).toArrow()
    labels = table["label"].to_numpy()
    values = table["v"].combine_chunks()
    flat, ends = values.flatten().to_numpy(zero_copy_only=False), np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))
    rows = np.split(flat, ends[:-1]) if len(ends) else []
    groups = np.array(table[by].to_pylist()) if by else np.zeros(len(labels), np.int64)
    return {g: _Held(labels[groups == g], [rows[i] for i in np.flatnonzero(groups == g)]) for g in np.unique(groups).tolist()}


def _rows(ids: np.ndarray, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    line, *scores = found
    return pa.RecordBatch.from_arrays([pa.array(ids[line], pa.int64()), *map(pa.array, scores)], _FOUND)


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("cand_id", *[F.round(c, 6).alias(c) for c in _FOUND[1:]])


def line_gains(series: DataFrame, cands: DataFrame, tasks: int, normalize: bool = True, by: str | None = None) -> DataFrame:
    """(cand_id, score, gap, tau) of cands(cand_id, values) against series(label, v), as ``metrics.scores`` gives them by gain; lines without a cut give no row.

    by: a column of both; candidates meet the series of their own group.
    """
    ship(series.sparkSession)
    shared = series.sparkSession.sparkContext.broadcast(_hold(series, by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            ids, values = batch.column("cand_id").to_numpy(), batch.column("values")
            lengths = values.value_lengths().to_numpy(zero_copy_only=False)
            groups = np.array(batch.column(by).to_pylist()) if by else np.zeros(len(ids), np.int64)
            for group in np.unique(groups).tolist():
                if group not in held:
                    continue
                mine = held[group]
                for length in np.unique(lengths[groups == group]):
                    rows = np.flatnonzero((groups == group) & (lengths == length))
                    if not length:
                        continue
                    for at in range(0, len(rows), step := max(1, LINES // mine.n)):
                        some = rows[at : at + step]
                        x = values.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
                        yield _rows(ids[some], best_cuts(mine.distances(x, normalize, normalize), mine.codes, mine.classes))

    chosen = cands.select(F.col("cand_id").cast("long").alias("cand_id"), F.col("values").cast("array<double>").alias("values"), *([by] if by else []))
    return _rounded(chosen.repartition(tasks, "cand_id").mapInArrow(run, FOUND))


def running_gains(series: DataFrame, sources: DataFrame, lengths: Sequence[int], tasks: int) -> DataFrame:
    """(cand_id, score, gap, tau) of all windows of sources(source, base, step, w) by ``sums.window_distances``, whose running sums go over a block of series at once."""
    from .sums import far_out_windows, levelled, moments, products_of

    ship(series.sparkSession)
    shared = series.sparkSession.sparkContext.broadcast(_hold(series, None))
    longest = max(lengths, default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value.get(0)
        if held is None:
            return
        tables = [[np.ascontiguousarray(np.array(x).T) for x in zip(*map(levelled, table), strict=True)] for table in held.tables]
        sides = {}
        for k, (y, y0) in enumerate(tables):
            for length in lengths:
                if length <= len(y):
                    w = np.lib.stride_tricks.sliding_window_view(y, length, axis=0)
                    sides[k, length] = (*moments(w), far_out_windows(y, y0, length))
        for batch in batches:
            for first, wide, w in zip(*(batch.column(c).to_pylist() for c in ("base", "step", "w")), strict=True):
                level = levelled(np.array(w or [], np.float64))
                # Some starts at a time, so that their lines fit.
                pace = max(longest, LINES // max(1, held.n))
                for at in range(0, len(level[0]), pace):
                    x, x0 = (v[at : at + pace + longest - 1] for v in level)
                    usable = [n for n in lengths if n <= len(x)]
                    dist = {n: np.empty((min(pace, len(x) - n + 1), held.n)) for n in usable}
                    lacks = {n: np.zeros(held.n, bool) for n in usable}
                    before = 0
                    for k, (y, y0) in enumerate(tables):
                        rows = y.shape[1]
                        for b in range(0, rows, block := max(1, CELLS // ((len(x) + 1) * (len(y) + 1)))):
                            own = slice(b, b + block)
                            into = slice(before + b, before + min(rows, b + block))
                            sums = None
                            for n in usable:
                                if n > len(y):
                                    lacks[n][into] = True
                                    continue
                                mean, inverse, far = (e[:, own] for e in sides[k, n])
                                sums, products = products_of(x, x0, y[:, own], y0[:, own], n, sums, far)
                                wx = np.lib.stride_tricks.sliding_window_view(x, n)
                                m, i = moments(wx)
                                products -= (n * m)[:, None, None] * mean
                                products *= inverse
                                rho = products.max(axis=1) * (i / n)[:, None]
                                dist[n][:, into] = np.sqrt(2 * (1 - np.clip(rho, -1, 1)))[: len(dist[n])]
                        before += rows
                    for n in usable:
                        codes, d = held.codes, dist[n]
                        if lacks[n].any():
                            codes, d = codes[~lacks[n]], d[:, ~lacks[n]]
                        yield _rows(first + wide * n + at + np.arange(len(d)), best_cuts(d, codes, held.classes))

    return _rounded(sources.repartition(tasks, "source").mapInArrow(run, FOUND))
