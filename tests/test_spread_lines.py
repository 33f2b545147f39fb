"""Cuts of order lines in many tasks against the scores by one window a line."""

import numpy as np

from seriesloom.operators import metrics


def lines(spark, seed, sizes, classes, ties):
    rng = np.random.default_rng(seed)
    rows = [(c, round(float(rng.normal(label * 0.2, 1)), ties), int(label)) for c, n in enumerate(sizes) for label in rng.integers(0, classes, n)]
    return spark.createDataFrame(rows, "cand long, dist double, label int")


def test_spread_cuts_are_those_of_one_window(spark):
    for seed, ties in ((1, 5), (2, 1), (3, 0)):
        line = lines(spark, seed, (3000, 40, 2, 1), 4, ties)
        want = {r.cand: (r.gain, r.gap, r.tau) for r in metrics.score(line, "ig").collect()}
        got = {r.cand: (r.gain, r.gap, r.tau) for r in metrics.spread_gains(line).collect()}
        assert got == want


def test_flat_lines_have_no_cut(spark):
    line = spark.createDataFrame([(0, 1.0, 0), (0, 1.0, 1), (1, 2.0, 0)], "cand long, dist double, label int")
    assert metrics.spread_gains(line).count() == 0
    assert metrics.spread_gains(line.where("false")).count() == 0
    assert metrics.spread_gains(line.where("cand = 0 AND dist = 1 AND label = 0")).count() == 0
