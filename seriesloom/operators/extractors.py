"""Discovery of shapelets: from labelled series to the windows (or learned arrays) that separate the classes best.

Every strategy turns a set of candidates into order lines with one distributed job and scores them with SQL; the
iterative ones keep only their population (a few arrays) on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lines
from .alignment import blended
from .distance import candidates, min_distances
from .fitness import logistic_losses
from .kernel_clusters import grouped
from .metrics import order_line, scores
from .profile import matrix_profile, motifs
from .sax import random_masks, sax_candidates
from .sums import sources_of, window_distances


def rank(cands: DataFrame, series: DataFrame, metric: str = "ig", normalize: bool = True) -> DataFrame:
    """cands with score, gap and tau.  Gains of many candidates are worked out line by line in the tasks (``lines``), other scores from rows by SQL."""
    if metric == "ig" and (tasks := lines.parts(series, cands)):
        return cands.join(lines.line_gains(series, cands, tasks, normalize), "cand_id", "left")
    found = scores(order_line(min_distances(series, cands, normalize)), metric)
    return cands.join(found.withColumnRenamed("cand", "cand_id"), "cand_id", "left")


def top(ranked: DataFrame, k: int) -> DataFrame:
    """The k best: by score, then gap, then source, length and start; null scores last."""
    return ranked.orderBy(F.col("score").desc_nulls_last(), F.col("gap").desc_nulls_last(), "series_id", "length", "start_idx").limit(k)


def without_overlap(ranked: DataFrame, k: int) -> DataFrame:
    """The k best of which none starts inside a better one of its series that was kept.

    All windows of a series pass by in order, best first; a task holds the kept ones of one series, k at most.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, kept = object(), []
        for batch in batches:
            chosen = []
            for i, (own, start, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("series_id", "start_idx", "length")), strict=True)):
                if own != source:
                    source, kept = own, []
                if len(kept) < k and not any(a <= start < b for a, b in kept):
                    kept.append((start, start + length))
                    chosen.append(i)
            yield batch.take(pa.array(chosen, pa.int64()))

    ordered = ranked.repartition("series_id").sortWithinPartitions("series_id", F.col("score").desc_nulls_last(), F.col("gap").desc_nulls_last(), "length", "start_idx")
    return top(ordered.mapInArrow(walk, ranked.schema), k)


@dataclass
class Brute:
    """All windows of lengths min_len .. max_len - 1 (and every step-th start)."""

    min_len: int = 4
    max_len: int | None = None
    metric: str = "ig"
    step: int = 1

    def extract(self, series: DataFrame, k: int = 1) -> DataFrame:
        most = self.max_len or series.agg(F.max(F.size("v"))).first()[0] or self.min_len
        return top(rank(candidates(series, range(self.min_len, most), self.step), series, self.metric), k)


@dataclass
class Fast:
    """What Brute finds, from running sums: all lengths of a pair of series after one pass.  Flat windows have correlation 0."""

    min_len: int = 4
    max_len: int | None = None
    metric: str = "ig"

    def extract(self, series: DataFrame, k: int = 1) -> DataFrame:
        most = self.max_len or series.agg(F.max(F.size("v"))).first()[0] or self.min_len
        lengths = range(self.min_len, most)
        cands = candidates(series, lengths)
        if self.metric == "ig" and (tasks := lines.parts(series, cands)):
            return top(cands.join(lines.running_gains(series, sources_of(series), lengths, tasks), "cand_id", "left"), k)
        found = scores(order_line(window_distances(series, lengths)), self.metric)
        return top(cands.join(found.withColumnRenamed("cand", "cand_id"), "cand_id", "left"), k)


@dataclass
class Sax:
    """Windows whose words collide unevenly under random masks, then scored; overlaps are left out."""

    lengths: tuple[int, ...] = (16,)
    parts: int = 8
    alphabet: int = 4
    hidden: int = 3
    iterations: int = 5
    per_length: int = 100
    metric: str = "ig"
    seed: int = 1337

    def extract(self, series: DataFrame, k: int = 1) -> DataFrame:
        cands = sax_candidates(series, self.lengths, self.parts, self.alphabet, random_masks(self.parts, self.hidden, self.iterations, self.seed), self.per_length)
        return without_overlap(rank(cands, series, self.metric), k)


def _frame(series: DataFrame, arrays: list[np.ndarray]) -> DataFrame:
    schema = "cand_id bigint, series_id bigint, start_idx int, length int, values array<double>"
    return series.sparkSession.createDataFrame([(i, i, 0, len(x), [float(y) for y in x]) for i, x in enumerate(arrays)], schema)


def _fitness(series: DataFrame, arrays: list[np.ndarray], metric: str, normalize: bool) -> np.ndarray:
    """Score of each array, from one job; what can't be scored has -inf."""
    found = scores(order_line(min_distances(series, _frame(series, arrays), normalize)), metric).select("cand", "score").collect()
    out = np.full(len(arrays), -np.inf)
    for r in found:
        out[r.cand] = -np.inf if r.score is None else r.score
    return out


def sample_windows(series: DataFrame, n: int, min_len: int, max_len: int, seed: int) -> list[np.ndarray]:
    """n windows of n series, chosen by a hash, at random starts and lengths."""
    rng = np.random.default_rng(seed)
    rows = series.where(F.size("v") >= min_len).orderBy(F.xxhash64("series_id", F.lit(seed))).limit(n).collect()
    out = []
    for i in range(n if rows else 0):
        v = np.array(rows[i % len(rows)].v)
        length = int(rng.integers(min_len, min(max_len, len(v)) + 1))
        start = int(rng.integers(0, len(v) - length + 1))
        out.append(v[start : start + length])
    return out


def _result(series: DataFrame, arrays: list[np.ndarray], metric: str, normalize: bool, k: int) -> DataFrame:
    return top(rank(_frame(series, arrays), series, metric, normalize), k)


def crossed(rng: np.random.Generator, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One- or two-point crossover."""
    n = min(len(a), len(b))
    cut = sorted(rng.integers(1, max(2, n), 2))
    if rng.random() < 0.5:
        return np.concatenate((a[: cut[0]], b[cut[0] :])), np.concatenate((b[: cut[0]], a[cut[0] :]))
    a, b = a.copy(), b.copy()
    a[cut[0] : cut[1]], b[cut[0] : cut[1]] = b[cut[0] : cut[1]].copy(), a[cut[0] : cut[1]].copy()
    return a, b


@dataclass
class Genetic:
    """One array per individual; roulette on shifted fitness, one- and two-point crossover, Gaussian noise, a hall of fame.

    history: mean, deviation and maximum of the finite fitness of every round's population, the first included.
    """

    population: int = 25
    iterations: int = 50
    mutation: float = 0.25
    crossover: float = 0.25
    wait: int = 5
    min_len: int = 4
    max_len: int = 64
    metric: str = "ig"
    seed: int = 1337
    history: list[tuple[float, float, float]] = field(default_factory=list, repr=False)

    def _note(self, fit: np.ndarray) -> None:
        real = fit[np.isfinite(fit)]
        if len(real):
            self.history.append((float(real.mean()), float(real.std()), float(real.max())))

    def extract(self, series: DataFrame, k: int = 1) -> DataFrame:
        rng = np.random.default_rng(self.seed)
        self.history = []
        people = sample_windows(series, self.population, self.min_len, self.max_len, self.seed)
        fit = _fitness(series, people, self.metric, False)
        self._note(fit)
        hall = sorted(zip(fit, range(len(people)), people, strict=True), key=lambda x: (-x[0], x[1]))[:k]
        still = 0
        for turn in range(self.iterations):
            real = np.where(np.isfinite(fit), fit, 0)
            share = real - real.min() + 1e-9
            people = [people[i].copy() for i in rng.choice(len(people), len(people), p=share / share.sum())]
            for i in range(0, len(people) - 1, 2):
                if rng.random() < self.crossover:
                    people[i], people[i + 1] = crossed(rng, people[i], people[i + 1])
            for p in people:
                if rng.random() < self.mutation:
                    p += rng.normal(0, 1, len(p)) * (rng.random(len(p)) < 0.2)
            fit = _fitness(series, people, self.metric, False)
            self._note(fit)
            best = hall[0][0]
            seen = {x[2].tobytes() for x in hall}
            new = [(f, turn * self.population + i, p.copy()) for i, (f, p) in enumerate(zip(fit, people, strict=True)) if p.tobytes() not in seen]
            hall = sorted(hall + new, key=lambda x: (-x[0], x[1]))[:k]
            still = 0 if hall[0][0] > best else still + 1
            if still >= self.wait:
                break
        return _result(series, [x[2] for x in hall], self.metric, False, k)


@dataclass
class Swarm:
    """Particles with a velocity towards their own best and the best of all, aligned at the best match where lengths differ.

    vary_length: particles also gain or lose points, and follow the best of all of their length (where a length has none
    yet, the best of all).  What has been found stays as it was scored.
    """

    particles: int = 50
    iterations: int = 25
    wait: int = 5
    min_len: int = 4
    max_len: int = 64
    metric: str = "ig"
    vary_length: bool = False
    change: float = 0.33
    speed: float = 0.25
    seed: int = 1337
    inertia: float = field(default=0.729, repr=False)
    gain: float = field(default=1.49445, repr=False)

    def extract(self, series: DataFrame, k: int = 1) -> DataFrame:
        rng = np.random.default_rng(self.seed)
        x = sample_windows(series, self.particles, self.min_len, self.max_len, self.seed)
        v = [rng.uniform(-self.speed, self.speed, len(p)) for p in x]
        fit = _fitness(series, x, self.metric, True)
        own, own_fit = [p.copy() for p in x], fit.copy()
        best, still = int(np.argmax(own_fit)), 0
        leaders: dict[int, tuple[float, np.ndarray]] = {}

        def lead() -> None:
            for f, p in zip(fit, x, strict=True):
                if np.isfinite(f) and (len(p) not in leaders or f > leaders[len(p)][0]):
                    leaders[len(p)] = float(f), p.copy()

        lead()
        for _ in range(self.iterations):
            for i in range(len(x)):
                if self.vary_length and rng.random() < self.change:
                    x[i], v[i] = self._resize(rng, x[i], v[i])
                goal = leaders[len(x[i])][1] if self.vary_length and len(x[i]) in leaders else own[best]
                pull = self._towards(x[i], own[i]) * rng.random(len(x[i])) + self._towards(x[i], goal) * rng.random(len(x[i]))
                v[i] = self.inertia * v[i] + np.clip(self.gain * pull, -self.speed, self.speed)
                x[i] = x[i] + v[i]
            fit = _fitness(series, x, self.metric, True)
            lead()
            before = own_fit[best]
            for i in np.flatnonzero(fit > own_fit):
                own[i], own_fit[i] = x[i].copy(), fit[i]
            best = int(np.argmax(own_fit))
            still = 0 if own_fit[best] > before else still + 1
            if still >= self.wait:
                break
        order = np.argsort(-own_fit, kind="stable")[:k]
        return _result(series, [own[i] for i in order], self.metric, True, k)

    @staticmethod
    def _towards(x: np.ndarray, goal: np.ndarray) -> np.ndarray:
        n, out = min(len(x), len(goal)), np.zeros(len(x))
        at = lambda a, b: int(np.argmin(((np.lib.stride_tricks.sliding_window_view(a, len(b)) - b) ** 2).sum(1)))
        if len(x) >= len(goal):
            p = at(x, goal)
            out[p : p + n] = goal - x[p : p + n]
        else:
            p = at(goal, x)
            out[:] = goal[p : p + n] - x
        return out

    def _resize(self, rng: np.random.Generator, *arrays: np.ndarray) -> list[np.ndarray]:
        n = len(arrays[0])
        size = int(rng.integers(self.min_len, self.max_len + 1))
        return [a[:size].copy() if size < n else np.concatenate((a, np.full(max(0, size - len(a)), a[-1]))) for a in arrays]


def kmeans_windows(series: DataFrame, k: int, length: int, sample: int = 2500, iterations: int = 20, seed: int = 1337) -> list[np.ndarray]:
    """Centres of a bounded sample of windows: starts for learning."""
    rng = np.random.default_rng(seed)
    w = np.array(sample_windows(series, sample, length, length, seed))
    if not len(w):
        return []
    centres = w[rng.choice(len(w), min(k, len(w)), replace=False)]
    for _ in range(iterations):
        near = ((w[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([w[near == i].mean(0) if (near == i).any() else centres[i] for i in range(len(centres))])
    return list(centres)


@dataclass
class Learned:
    """Arrays and a linear classifier learned together by gradient descent on soft-minimum distances.

    sizes: {length: arrays} learns several lengths at once; without it ``shapelets`` arrays of one length.  Series shorter than
    the longest array are left out.  Every step is one job: tasks sum the gradient over their series, the shuffle adds the sums up.
    """

    length: int = 16
    shapelets: int = 3
    sizes: dict[int, int] | None = None
    steps: int = 20
    rate: float = 0.5
    alpha: float = -25.0
    regular: float = 1e-3
    metric: str = "ig"
    seed: int = 1337

    def fit(self, series: DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[float]]:
        """(a table of arrays per length, weights, bias, mean loss of each step); labels are 0 .. classes - 1."""
        classes = (series.agg(F.max("label")).first()[0] or 0) + 1
        starts = [np.array(kmeans_windows(series, k, length, seed=self.seed)) for length, k in sorted((self.sizes or {self.length: self.shapelets}).items())]
        blocks = [x for x in starts if len(x)]
        w, b, losses = np.zeros((sum(map(len, blocks)), classes)), np.zeros(classes), []
        for _ in range(self.steps if blocks else 0):
            sums = self._gradient(series, blocks, w, b)
            flat = np.array([r.total for r in sums.groupBy("at").agg(F.sum("value").alias("total")).orderBy("at").collect()])
            if not len(flat) or not flat[0]:
                break
            n, loss = flat[:2]
            losses.append(loss / n)
            *steps, dw, db = np.split(flat[2:] / n, np.cumsum([*(x.size for x in blocks), w.size]))
            blocks = [x - self.rate * d.reshape(x.shape) for x, d in zip(blocks, steps, strict=True)]
            w = w - self.rate * (dw.reshape(w.shape) + self.regular * w)
            b = b - self.rate * db
        return blocks, w, b, losses

    def _gradient(self, series: DataFrame, blocks: list[np.ndarray], w: np.ndarray, b: np.ndarray) -> DataFrame:
        alpha, longest = self.alpha, max(x.shape[1] for x in blocks)
        at = np.cumsum([len(x) for x in blocks])[:-1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + sum(x.size for x in blocks) + w.size + b.size)
            for batch in batches:
                for label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if v is None or len(v) < longest:
                        continue
                    x, parts = np.array(v), []
                    for s in blocks:
                        diff = s[:, None] - np.lib.stride_tricks.sliding_window_view(x, s.shape[1])[None]
                        d = (diff * diff).mean(-1)
                        e = np.exp(alpha * (d - d.min(1, keepdims=True)))
                        p = e / e.sum(1, keepdims=True)
                        parts.append((diff, d, p, (p * d).sum(1)))
                    m = np.concatenate([part[3] for part in parts])
                    logits = m @ w + b
                    q = np.exp(logits - logits.max())
                    q /= q.sum()
                    loss = -np.log(max(q[label], 1e-300))
                    q[label] -= 1
                    slopes = []
                    for (diff, d, p, own), dm in zip(parts, np.split(w @ q, at), strict=True):
                        dd = p * (1 + alpha * (d - own[:, None])) * dm[:, None]
                        slopes.append((dd[:, :, None] * 2 * diff / diff.shape[2]).sum(1).ravel())
                    total += np.concatenate(([1, loss], *slopes, np.outer(m, q).ravel(), q))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "value"])

        return series.select("label", "v").mapInArrow(run, "at int, value double")

    def extract(self, series: DataFrame, k: int = 1) -> DataFrame:
        return _result(series, [x for block in self.fit(series)[0] for x in block], self.metric, True, k)


@dataclass
class MultiGenetic:
    """Individuals are sets of arrays; fitness: cross-validated log-loss of a logistic regression on their distances, then fewer points.

    Starts mix k-means centres, discords of sampled series and random windows.  Parents swap arrays (crossover) and are blended with their
    nearest partners by the alignment kernel (blend).  With ``guided`` over 0, a random array of an individual is crossed, at that rate, with
    another of its cluster: all arrays of the population are clustered by the kernel in every round.  ``history`` has a row a round: mean,
    deviation and maximum of the fitness (negative log-loss), as of the round's population.
    """

    population: int = 10
    iterations: int = 10
    noise: float = 0.3
    add: float = 0.3
    remove: float = 0.3
    crossover: float = 0.66
    blend: float = 0.33
    wait: int = 5
    min_len: int = 4
    max_len: int = 32
    folds: int = 3
    guided: float = 0.0
    seed: int = 1337
    history: list[tuple[float, float, float]] = field(default_factory=list, repr=False)

    def _start(self, series: DataFrame, rng: np.random.Generator, turn: int) -> list[np.ndarray]:
        n = int(rng.integers(2, 5))
        draw = rng.random()
        if draw < 0.25:
            return kmeans_windows(series, n, int(rng.integers(self.min_len, self.max_len)), 100, 5, self.seed + turn)
        if draw < 0.65:
            length = max(4, int(rng.integers(self.min_len, self.max_len)))
            few = series.orderBy(F.xxhash64("series_id", F.lit(self.seed + turn))).limit(n)
            found = motifs(matrix_profile(few.select(F.col("series_id").alias("seq_id"), F.array("v").alias("v")), length), largest=True)
            rows = found.join(few, F.col("seq_id") == F.col("series_id")).select("v", "pos").collect()
            out = [np.array(r.v[r.pos : r.pos + length]) for r in rows]
            if out:
                return out
        return sample_windows(series, n, self.min_len, self.max_len, self.seed + turn)

    def _losses(self, series: DataFrame, people: list[list[np.ndarray]]) -> list[tuple[float, int]]:
        """Held-out log-loss of each set's logistic regression, all fitted together; then its points."""
        return [(loss, sum(map(len, p))) for loss, p in zip(logistic_losses(series, people, self.folds, self.seed), people, strict=True)]

    def _guide(self, series: DataFrame, rng: np.random.Generator, people: list[list[np.ndarray]]) -> None:
        """Cross arrays with mates of their cluster; an array without a mate stays."""
        arrays = [x for p in people for x in p]
        clusters = grouped(series.sparkSession, arrays)
        members = {c: np.flatnonzero(clusters == c) for c in np.unique(clusters)}
        first = np.cumsum([0, *map(len, people)])
        for i, p in enumerate(people):
            if rng.random() < self.guided:
                j = int(rng.integers(len(p)))
                own = first[i] + j
                mates = members[clusters[own]]
                mates = mates[mates != own]
                if len(mates):
                    p[j] = crossed(rng, p[j], arrays[rng.choice(mates)])[0]

    def _note(self, fit: list[tuple[float, int]]) -> None:
        scores = -np.array([loss for loss, _ in fit])
        self.history.append((float(scores.mean()), float(scores.std()), float(scores.max())))

    def extract(self, series: DataFrame, k: int | None = None) -> DataFrame:
        """The shapelets of the best set, ranked; k of them if given."""
        self.history = []
        rng = np.random.default_rng(self.seed)
        people = [self._start(series, rng, i) for i in range(self.population)]
        fit = self._losses(series, people)
        self._note(fit)
        best = min(range(len(people)), key=lambda i: fit[i])
        hall, hall_fit, still = people[best], fit[best], 0
        for turn in range(self.iterations):
            chosen = [min(rng.integers(0, len(people), 3), key=lambda i: fit[i]) for _ in range(self.population - 1)]
            people = [[x.copy() for x in people[i]] for i in chosen]
            for i in range(0, len(people) - 1, 2):
                if rng.random() < self.crossover:
                    a, b = int(rng.integers(len(people[i]))), int(rng.integers(len(people[i + 1])))
                    people[i][a], people[i + 1][b] = people[i + 1][b], people[i][a]
                if rng.random() < self.blend:
                    people[i], people[i + 1] = blended(people[i], people[i + 1])
            if self.guided:
                self._guide(series, rng, people)
            for p in people:
                if rng.random() < self.noise:
                    j = int(rng.integers(len(p)))
                    p[j] = p[j] + rng.normal(0, 0.1, len(p[j])) * (rng.random(len(p[j])) < 0.15)
                if rng.random() < self.add:
                    p += sample_windows(series, 1, self.min_len, self.max_len, self.seed + 1000 * (turn + 1) + len(p))
                if rng.random() < self.remove and len(p) > 1:
                    p.pop(int(rng.integers(len(p))))
            people.append(hall)
            fit = self._losses(series, people)
            self._note(fit)
            best = min(range(len(people)), key=lambda i: fit[i])
            still = 0 if fit[best] < hall_fit else still + 1
            hall, hall_fit = people[best], fit[best]
            if still >= self.wait:
                break
        return _result(series, hall, "ig", False, k or len(hall))


EXTRACTORS = {"brute": Brute, "fast": Fast, "sax": Sax, "learn": Learned, "genetic": MultiGenetic, "single_genetic": Genetic, "pso": Swarm}


def extractor(method: object) -> object:
    """An extractor by name, or anything with ``extract(series, k)``."""
    if isinstance(method, str):
        return EXTRACTORS[method]()
    if not hasattr(method, "extract"):
        raise TypeError("an extractor needs extract(series, k)")
    return method

