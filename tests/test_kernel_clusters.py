"""Kernel clusters against plain loops on the full kernel matrix; crossover within clusters."""

import numpy as np

from seriesloom.operators import alignment
from seriesloom.operators.extractors import MultiGenetic, crossed
from seriesloom.operators.kernel_clusters import KernelKMeans, gram_of, grouped, kernels, silhouette, spread_starts


def shapes(rng):
    """Three shapes of several lengths, twelve of each."""
    out = []
    for i in range(36):
        t = np.linspace(0, 1, 8 + i % 3)
        out.append((np.sin(6 * t), 3 * t, -2 * np.ones_like(t))[i // 12] + 0.05 * rng.normal(size=len(t)))
    return out


def test_kernels_by_pairs(spark):
    rng = np.random.default_rng(1)
    arrays = [rng.normal(size=n) for n in (1, 4, 4, 7, 30)]
    want = alignment.similarities(arrays, arrays, 1.5)
    assert np.allclose(kernels(arrays, arrays, 1.5), want, rtol=1e-9)
    assert np.allclose(gram_of(spark, arrays, 1.5), want, rtol=1e-9)


def test_clusters_of_the_full_kernel(spark):
    rng = np.random.default_rng(2)
    arrays = shapes(rng)
    rows = [(i, v.tolist()) for i, v in enumerate(arrays)] + [(80, None), (81, []), (82, [1.0, None]), (83, [float("nan")])]
    rows += [(90, arrays[0].tolist())]
    series = spark.createDataFrame(rows, "series_id long, v array<double>").repartition(3)
    model = KernelKMeans(3, 10).fit(series)
    got = {r.series_id: (r.cluster, r.dist) for r in model.predict(series).collect()}
    assert got.keys() == {*range(36), 90}
    assert model.inertia == sorted(model.inertia, reverse=True)
    # The same steps on distances from the kernel matrix alone, from the same first clusters.
    every = [*arrays, arrays[0]]
    gram = alignment.similarities(every, every, model.width)
    starts = KernelKMeans(3, 0).fit(series)
    first = {r.series_id: r.cluster for r in starts.predict(series).collect()}
    labels = np.array([first[i] for i in [*range(36), 90]])
    for _ in range(10):
        d = []
        for c in range(3):
            own = labels == c
            d.append(np.diag(gram) - 2 * gram[:, own].mean(1) + gram[np.ix_(own, own)].mean())
        d = np.round(np.array(d).T, 7)
        labels = d.argmin(1)
    assert [got[i][0] for i in [*range(36), 90]] == labels.tolist()
    assert all(abs(got[i][1] - d[at, labels[at]]) < 1e-6 for at, i in enumerate([*range(36), 90]))
    assert len({tuple(labels[i : i + 12]) for i in (0, 12, 24)}) == 3 and all(len(set(labels[i : i + 12])) == 1 for i in (0, 12, 24))
    few = KernelKMeans(3, 10, landmarks=8).fit(series)
    assert few.predict(series).count() == 37
    assert KernelKMeans(2).fit(series.where("false")).predict(series).count() == 0


def test_groups_of_a_population(spark):
    labels = grouped(spark, shapes(np.random.default_rng(3)))
    assert len(set(labels)) == 3 and all(len(set(labels[i : i + 12])) == 1 for i in (0, 12, 24))
    assert grouped(spark, [np.ones(3)]).tolist() == [0] and grouped(spark, []).tolist() == []
    assert len(set(grouped(spark, [np.ones(4)] * 5))) == 1
    x = np.array([0.0, 0.1, 5.0, 5.1, 20.0])
    d, g = abs(x[:, None] - x[None]), np.array([0, 0, 1, 1, 2])
    want = []
    for i in range(4):
        a = d[i, (g == g[i]) & (np.arange(5) != i)].mean()
        b = min(d[i, g == c].mean() for c in range(3) if c != g[i])
        want.append((b - a) / max(a, b))
    assert abs(silhouette(d, g) - np.mean([*want, 0])) < 1e-12
    assert len(spread_starts(np.ones((4, 2)), 3)) == 1


def test_crossover_stays_within_clusters(spark):
    """Clusters hold values of one range each; so must the arrays that come of their crossing."""
    rng = np.random.default_rng(4)
    people = [[base + rng.random(6) for base in (0, 100, 200)] for _ in range(8)]
    series = spark.createDataFrame([(0, 0, [0.0] * 8)], "series_id long, label int, v array<double>")
    before = [[x.copy() for x in p] for p in people]
    MultiGenetic(guided=1.0)._guide(series, rng, people)
    changed = [(i, j) for i, p in enumerate(people) for j, x in enumerate(p) if not np.array_equal(x, before[i][j])]
    assert len(changed) >= 4 and len({i for i, _ in changed}) == len(changed)
    assert all(100 * j <= x.min() and x.max() <= 100 * j + 1 for p in people for j, x in enumerate(p))
    a, b = crossed(rng, np.zeros(5), np.ones(9))
    assert len(a) + len(b) == 14 and a.sum() + b.sum() == 9


def test_guided_search_notes_its_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, (rng.normal(size=16) + (np.hanning(16) * 6 if i % 2 else 0)).tolist()) for i in range(24)]
    series = spark.createDataFrame(rows, "series_id long, label int, v array<double>")
    search = MultiGenetic(population=5, iterations=2, min_len=4, max_len=8, guided=0.7)
    found = search.extract(series).collect()
    assert found and len(search.history) == 3
    # The best set is carried on, so the maximum never falls.
    best = [h[2] for h in search.history]
    assert best == sorted(best) and all(h[0] <= h[2] and h[1] >= 0 for h in search.history)
