import numpy as np
import pytest

from seriesloom.operators import evaluation, learners
from seriesloom.operators.extractors import Brute


def test_learners_separate(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, i % 2, (rng.normal(size=3) + 6 * (i % 2)).tolist()) for i in range(60)], "series_id long, label int, features array<double>")
    for kind in ("lr",):
        assert evaluation.accuracy(learners.fit_predict(kind, rows, rows, folds=2)).first().accuracy == 1.0
    with pytest.raises(KeyError):
        learners.fit_predict("other", rows, rows)


def test_length_bounds_and_sweep(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, i % 2, rng.normal(size=20).tolist()) for i in range(12)], "series_id long, label int, v array<double>")
    low, high = learners.estimate_lengths(rows, Brute(5, 8, step=6), rounds=2, per_label=3, k=3)
    assert 5 <= low < high <= 8
    assert learners.sweep([{"x": 1}, {"x": 2}], lambda x: x / 2) == [{"x": 1, "accuracy": 0.5}, {"x": 2, "accuracy": 1.0}]
