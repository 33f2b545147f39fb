"""Exact resampling with replacement, and divergences over all dimensions against numpy."""

from collections import Counter

import numpy as np
import pytest

from seriesloom.operators import separability
from seriesloom.sources import series as S


def test_the_draws_of_all_blocks_add_up(monkeypatch):
    monkeypatch.setattr(S, "DRAW_BLOCK", 10)
    for rows, size in ((95, 95), (1, 7), (10, 0), (101, 250)):
        parts = [S.draws(b, rows, size, 3) for b in range(-(-rows // 10))]
        assert sum(map(len, parts)) == rows and sum(p.sum() for p in parts) == size
    # Each row is drawn as often as any other, on average.
    mean = np.mean([np.concatenate([S.draws(b, 35, 35, seed) for b in range(4)]) for seed in range(2000)], axis=0)
    assert np.abs(mean - 1).max() < 0.12


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0, 2.5])
def test_bootstrap_has_the_exact_size(spark, share):
    rows = spark.createDataFrame([(i % 40, i % 3, [float(i)]) for i in range(120)] + [(None, 1, None)], "series_id long, label int, v array<double>").repartition(5)
    one, two = (Counter((r.series_id, tuple(r.v or ())) for r in S.bootstrap(t, share).collect()) for t in (rows, rows.repartition(3)))
    assert sum(one.values()) == round(share * 121) and one == two
    if share == 1.0:
        # Rows with one id are drawn apart.
        assert any(len({one[i, (float(i + 40 * j),)] for j in range(3)}) > 1 for i in range(40))
        assert one != Counter((r.series_id, tuple(r.v or ())) for r in S.bootstrap(rows, share, 5).collect())


def test_bootstrap_of_nothing(spark):
    rows = spark.createDataFrame([], "series_id long, label int, v array<double>")
    assert S.bootstrap(rows).count() == 0
    with pytest.raises(ValueError):
        S.bootstrap(rows, -1)


def shares(x, y, bins):
    low, width = x.min(0), (x.max(0) - x.min(0)) / bins
    cell = np.minimum(bins - 1, np.floor((x - low) / np.where(width == 0, 1, width))).astype(int)
    return cell, {k: cell[y == k] for k in np.unique(y)}


def kl(p, q):
    return sum(v * np.log(v / q[c]) for c, v in p.items() if v)


def histogram(cells):
    n = Counter(cells)
    return {c: v / len(cells) for c, v in n.items()}


def test_divergences_of_all_dimensions(spark):
    rng = np.random.default_rng(1)
    x, y = np.column_stack((rng.normal(size=90), rng.exponential(size=90), np.ones(90))), rng.integers(0, 3, 90)
    x[:, 0] += y
    rows = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(90)] + [(100, 1, None)], "series_id long, label int, v array<double>")
    _, parts = shares(x, y, 6)
    got = {(r.dim, r.label_a, r.label_b): r.jsd for r in separability.jensen_shannon(rows, 6).collect()}
    mixed = {r.dim: r.jsd for r in separability.jensen_shannon_mixture(rows, 6).collect()}
    for d in range(3):
        p = {k: histogram(c[:, d].tolist()) for k, c in parts.items()}
        for a in range(3):
            for b in range(a + 1, 3):
                m = {c: (p[a].get(c, 0) + p[b].get(c, 0)) / 2 for c in {*p[a], *p[b]}}
                assert abs(got[d, a, b] - (kl(p[a], m) + kl(p[b], m)) / 2) < 2e-6
        m = {c: sum(q.get(c, 0) for q in p.values()) / 3 for c in set().union(*p.values())}
        assert abs(mixed[d] - sum(kl(q, m) for q in p.values()) / 2) < 2e-6
    p = {k: histogram(list(map(tuple, c.tolist()))) for k, c in parts.items()}
    m = {c: sum(q.get(c, 0) for q in p.values()) / 3 for c in set().union(*p.values())}
    assert abs(separability.jensen_shannon_mixture(rows, 6, joint=True).first().jsd - sum(kl(q, m) for q in p.values()) / 2) < 2e-6


def test_coefficient_over_all_dimensions(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 3, (200, 12)).astype(float), rng.integers(0, 2, 200)
    x[:80] = x[0]
    x[:, 11] = 4
    rows = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(200)], "series_id long, label int, v array<double>")
    cell = np.floor((x[:, :11] - x[:, :11].min(0)) / ((x[:, :11].max(0) - x[:, :11].min(0)) / 2)).astype(int)
    a, b = (histogram(list(map(tuple, cell[y == k].tolist()))) for k in (0, 1))
    want = sum(np.sqrt(v * b[c]) for c, v in a.items() if c in b)
    assert want > 0 and abs(separability.bhattacharyya(rows, cells=2).first().coefficient - want) < 2e-6
    assert separability.bhattacharyya(rows.where("false")).first().coefficient == 1.0
