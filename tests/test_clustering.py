"""Warped clusters against plain loops, silhouettes and dispersion against all pairs."""

import numpy as np

from seriesloom.operators import clustering
from seriesloom.operators.clustering import WarpedKMeans


def path(x, c):
    """(squared distance, matches) of the best warping path, diagonal steps first."""
    n, m = len(x), len(c)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i, j] = (x[i - 1] - c[j - 1]) ** 2 + min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
    i, j, met = n, m, []
    while i and j:
        met.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda at: cost[at])
    return cost[n, m], met


def lloyd(series, centres, rounds):
    centres = [c.copy() for c in centres]
    near = lambda x: min((round(float(np.sqrt(path(x, c)[0])), 9), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = [near(x)[1] for x in series]
        new = [c.copy() for c in centres]
        for k, c in enumerate(centres):
            points = [[] for _ in c]
            for x, g in zip(series, groups, strict=True):
                if g == k:
                    for i, j in path(x, c)[1]:
                        points[j].append(x[i])
            if points[0]:
                new[k] = np.array([np.mean(p) for p in points])
        centres[:] = new
    return [near(x) for x in series], centres


def test_warped_clusters(spark):
    rng = np.random.default_rng(3)
    values = [np.roll(np.hanning(12), s) * (3 if s % 2 else -2) + 0.1 * rng.normal(size=12) for s in range(14)] + [rng.normal(size=n) for n in (1, 5, 9)]
    rows = [(i, v.tolist()) for i, v in enumerate(values)] + [(90, None), (91, [])]
    series = spark.createDataFrame(rows, "series_id long, v array<double>").repartition(4)
    model = WarpedKMeans(3, 0).fit(series)
    starts = model.centres
    model = WarpedKMeans(3, 4).fit(series)
    want, centres = lloyd(values, starts, 4)
    assert all(np.allclose(a, b) for a, b in zip(model.centres, centres, strict=True))
    got = {r.series_id: (r.dist, r.cluster) for r in model.predict(series).collect()}
    assert got.keys() == set(range(17)) and all(got[i][1] == c and abs(got[i][0] - d) < 1e-6 for i, (d, c) in enumerate(want))
    assert model.inertia == sorted(model.inertia, reverse=True)
    assert WarpedKMeans(2).fit(series.where("false")).predict(series).count() == 0


def test_silhouettes_and_dispersion(spark):
    rng = np.random.default_rng(4)
    x, g = rng.normal(size=(60, 5)), rng.integers(0, 3, 60)
    x[:, 0] += 2 * g
    g[59] = 7
    rows = spark.createDataFrame([(i, int(g[i]), x[i].tolist()) for i in range(60)] + [(80, 1, None), (81, None, x[0].tolist())], "series_id long, cluster int, v array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = {}
    for i in range(60):
        own = (g == g[i]) & (np.arange(60) != i)
        a, b = d[i, own].mean() if own.any() else 0, min(d[i, g == k].mean() for k in set(g.tolist()) - {g[i]})
        want[i] = (b - a) / max(a, b) if own.any() else 0.0
    got = {r.series_id: r.silhouette for r in clustering.silhouettes(rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - v) < 1e-9 for i, v in want.items())
    mean = {k: x[g == k].mean(0) for k in set(g.tolist())}
    within = sum(((x[g == k] - m) ** 2).sum() for k, m in mean.items())
    between = sum((g == k).sum() * ((m - x.mean(0)) ** 2).sum() for k, m in mean.items())
    assert abs(clustering.calinski_harabasz(rows).first().score - (between / 3) / (within / 56)) < 1e-5
    assert clustering.calinski_harabasz(rows.where("cluster = 1")).first().score is None
    assert clustering.silhouettes(rows.where("false")).count() == 0
