"""Losses of many sets fitted together against plain fits of one at a time."""

import numpy as np
import pytest

from seriesloom.operators import fitness
from seriesloom.operators.distance import min_distances


def plain(d, y, fold, folds, strength=1.0):
    """Mean held-out log-loss by gradient descent with a line search on one model at a time."""
    classes = sorted(set(y))
    t = np.array([[c == v for c in classes] for v in y], float)
    x = np.column_stack((d, np.ones(len(d))))
    total = 0.0
    for f in range(folds):
        a, b = x[fold != f], t[fold != f]
        w = np.zeros((x.shape[1], len(classes)))
        free = np.ones_like(w)
        free[-1] = 0

        def cost(w, a=a, b=b, free=free):
            z = a @ w
            m = z.max(1, keepdims=True)
            return (np.log(np.exp(z - m).sum(1)) + m[:, 0] - (z * b).sum(1)).sum() + (free * w * w).sum() / (2 * strength)

        rate = 1.0
        for _ in range(20_000):
            z = a @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = a.T @ (p - b) + free * w / strength
            while cost(w - rate * g) > cost(w) - rate / 2 * (g * g).sum() and rate > 1e-14:
                rate /= 2
            w = w - rate * g
            rate *= 1.5
            if np.abs(g).max() < 1e-7:
                break
        z = x[fold == f] @ w
        p = np.exp(z - z.max(1, keepdims=True))
        total -= np.log((p / p.sum(1, keepdims=True))[t[fold == f] > 0]).sum()
    return total / len(d)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):
        v = 0.4 * rng.normal(size=24)
        v[5 + i % 7 : 11 + i % 7] += [0, 2, -2][i % 3] * rng.uniform(0.3, 1)
        rows.append((i, i % 3, v.tolist()))
    return spark.createDataFrame([*rows, (900, None, rows[0][2]), (901, 1, None), (902, 1, [])], "series_id long, label int, v array<double>").repartition(4)


def test_losses_equal_plain_fits(spark, series):
    rng = np.random.default_rng(4)
    values = np.array([r.v for r in series.where("series_id < 90").orderBy("series_id").collect()])
    sets = [[values[1, 4:12], values[2, 3:13]], [rng.normal(size=5)], [values[i, i : i + 6] for i in range(4)]]
    got = fitness.logistic_losses(series, sets, 3, 11)
    cands = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(x for s in sets for x in s)], "cand_id long, values array<double>")
    d = {(r.series_id, r.cand_id): r.dist for r in min_distances(series, cands, False).collect()}
    fold = {r.series_id: r.f for r in series.selectExpr("series_id", "pmod(xxhash64(series_id, 11), 3) AS f").collect()}
    at = 0
    for s, loss in zip(sets, got, strict=True):
        x = np.array([[d[i, at + j] for j in range(len(s))] for i in range(90)])
        at += len(s)
        assert abs(plain(x, [i % 3 for i in range(90)], np.array([fold[i] for i in range(90)]), 3) - loss) < 1e-4
    assert got[0] < got[1]


def test_a_population_of_fifty(spark, series):
    rng = np.random.default_rng(6)
    sets = [[rng.normal(size=int(rng.integers(4, 9))) for _ in range(int(rng.integers(2, 5)))] for _ in range(50)]
    losses = fitness.logistic_losses(series, sets)
    assert len(losses) == 50 and all(np.isfinite(losses))


def test_no_series_and_one_class(series):
    assert fitness.logistic_losses(series.where("false"), [[np.ones(4)]]) == [float("inf")]
    assert fitness.logistic_losses(series.where("label = 1"), [[np.ones(4)], [np.ones(5)]]) == [float("inf")] * 2
