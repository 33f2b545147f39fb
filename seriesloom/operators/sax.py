"""Symbolic aggregate approximation: words of windows, their distance, and collisions under random masks."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .distance import window_ids


def breakpoints(alphabet: int) -> list[float]:
    """What cuts the normal distribution into equal parts."""
    return [NormalDist().inv_cdf(i / alphabet) for i in range(1, alphabet)]


def distance_table(alphabet: int) -> list[list[float]]:
    b = breakpoints(alphabet)
    return [[0.0 if abs(i - j) <= 1 else b[max(i, j) - 1] - b[min(i, j)] for j in range(alphabet)] for i in range(alphabet)]


def paa(v: Column, length: int, parts: int, long_tail: bool = True) -> Column:
    """Means of ``parts`` segments of an array of ``length``; long_tail: the last one starts where the one before it does."""
    width = length // parts
    starts = [i * width for i in range(parts)]
    if long_tail and parts > 1:
        starts[-1] = (parts - 2) * width
    ends = [(i + 1) * width for i in range(parts - 1)] + [length]
    return F.array(*[A.mean(F.slice(v, a + 1, b - a)) for a, b in zip(starts, ends, strict=True)])


def word(means: Column, alphabet: int) -> Column:
    """Symbols 0 to alphabet - 1; a value at a breakpoint has the higher one."""
    cuts = F.array(*[F.lit(b) for b in breakpoints(alphabet)])
    return F.transform(means, lambda x: F.size(F.filter(cuts, lambda b: b <= x)))


def words(series: DataFrame, length: int, parts: int = 8, alphabet: int = 4, long_tail: bool = True) -> DataFrame:
    """(series_id, label, pos, word) of every window of a length."""
    if length < parts:
        raise ValueError("windows must have a point for every symbol")
    rows = series.select("series_id", "label", F.posexplode_outer(A.windows(F.col("v"), length)).alias("pos", "w")).where("w IS NOT NULL")
    rows = rows.select("series_id", "label", "pos", A.z_norm(F.col("w")).alias("z"))
    # Rounded, so that values at a breakpoint don't hang on the order of a sum.
    means = F.transform(paa(F.col("z"), length, parts, long_tail), lambda x: F.round(x, 9))
    return rows.select("series_id", "label", "pos", means.alias("means")).select("series_id", "label", "pos", word(F.col("means"), alphabet).alias("word"))


def word_distance(x: Column, y: Column, length: int, parts: int, alphabet: int) -> Column:
    """sqrt(length / parts) times the sum over the table of symbol distances."""
    table = F.array(*[F.array(*[F.lit(c) for c in row]) for row in distance_table(alphabet)])
    cells = F.zip_with(x, y, lambda a, b: F.element_at(F.element_at(table, a + 1), b + 1))
    return F.sqrt(F.lit(length / parts)) * A.total(cells)


def random_masks(parts: int, hidden: int, iterations: int, seed: int = 1337) -> list[list[int]]:
    """Positions that each iteration keeps."""
    rng = np.random.default_rng(seed)
    return [sorted(rng.choice(parts, parts - hidden, replace=False).tolist()) for _ in range(iterations)]


def power(series: DataFrame, coded: DataFrame, masks: list[list[int]]) -> DataFrame:
    """(series_id, pos, power): how unevenly the classes' series collide with a window's word under the masks.

    A word's score for a class is the number of its series with the same masked word, summed over masks;
    2 * score less the most possible is its difference d; power: sum |d| - |max d| - |min d| + |max d - min d|.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("turn"), F.transform(F.array(*map(F.lit, m)), lambda k: F.element_at("word", k + 1)).alias("key")) for i, m in enumerate(masks)])
    rows = coded.select("series_id", "label", "pos", F.explode(keys).alias("k")).select("series_id", "label", "pos", "k.turn", "k.key")
    hits = rows.groupBy("turn", "key", F.col("label").alias("class")).agg(F.countDistinct("series_id").alias("n"))
    found = rows.join(hits, ["turn", "key"]).groupBy("series_id", "pos", "class").agg(F.sum("n").alias("score"))
    classes = series.groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("size"))
    # The classes are few: every window meets each of them, so that classes without a collision count too.
    grid = coded.select("series_id", "pos").crossJoin(F.broadcast(classes)).join(found, ["series_id", "pos", "class"], "left")
    d = grid.select("series_id", "pos", (2 * F.coalesce("score", F.lit(0)) - F.col("size") * len(masks)).alias("d"))
    value = F.sum(F.abs("d")) - F.abs(F.max("d")) - F.abs(F.min("d")) + F.abs(F.max("d") - F.min("d"))
    return d.groupBy("series_id", "pos").agg(value.alias("power"))


def top_windows(powers: DataFrame, n: int) -> DataFrame:
    """The n windows of greatest power; ties by series and position."""
    return powers.orderBy(F.desc("power"), "series_id", "pos").limit(n)


def sax_candidates(series: DataFrame, lengths: tuple[int, ...], parts: int = 8, alphabet: int = 4, masks: list[list[int]] | None = None, per_length: int = 100) -> DataFrame:
    """(cand_id, series_id, start_idx, length, values) of the best windows of each length."""
    masks = masks or random_masks(parts, 3, 5)
    out = None
    for length in lengths:
        best = top_windows(power(series, words(series, length, parts, alphabet), masks), per_length)
        rows = best.join(series.select("series_id", "v"), "series_id")
        cand = window_ids(series, F.lit(length), "pos")
        rows = rows.select(cand.alias("cand_id"), "series_id", F.col("pos").alias("start_idx"), F.lit(length).alias("length"), F.slice("v", F.col("pos") + 1, length).alias("values"))
        out = rows if out is None else out.unionAll(rows)
    return out


