"""Running sums over spikes, neighbours of ragged and null series, warped neighbours by a bound, streams beyond a block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import blocks, distance, sums
from seriesloom.streaming.transform import stream_distances


def direct(x, y, length):
    z = lambda v: (lambda w: (w - w.mean(1, keepdims=True)) / np.where(w.std(1, keepdims=True) == 0, np.inf, w.std(1, keepdims=True)))(np.lib.stride_tricks.sliding_window_view(v, length))
    return z(x) @ z(y).T / length


@pytest.mark.parametrize("spike", [0, 1e3, 1e5, 1e6, 1e12])
def test_correlations_after_a_spike(spike):
    rng = np.random.default_rng(3)
    x, y = 0.1 * rng.normal(size=60) + 2, 0.1 * rng.normal(size=70)
    x[5] += spike
    y[60] -= spike
    x[30:40] = 2
    assert np.abs(sums.correlations(x, y, 8) - direct(x, y, 8)).max() < 1e-8


def test_window_distances_in_steps(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, (rng.normal(size=40) + (1e6 if i == 2 else 0) * (np.arange(40) == 11)).tolist()) for i in range(5)] + [(7, 0, None), (8, 1, []), (9, 1, [1.0, 2.0, 4.0])]
    series = spark.createDataFrame(rows, "series_id long, label int, v array<double>")
    read = lambda: {(r.cand_id, r.series_id): (r.dist, r.pos) for r in sums.window_distances(series, [3, 6]).collect()}
    whole = read()
    x, y = np.array(rows[0][2]), np.array(rows[2][2])
    d = np.sqrt(np.maximum(2 - 2 * direct(x, y, 6), 0))
    assert all(abs(whole[6000 + i, 2][0] - d[i].min()) < 1e-6 for i in range(35))
    monkeypatch.setattr(sums, "CELLS", 100)
    again = read()
    assert again.keys() == whole.keys() and all(abs(again[key][0] - d) < 5e-6 for key, (d, _) in whole.items())


def test_the_bound_is_under_the_warped_distance():
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (1, 5), (7, 4), (9, 9)):
        x, y = rng.normal(size=(12, n)) + rng.normal(size=(12, 1)), rng.normal(size=(10, m))
        d = blocks.dtw(x, y)
        assert (blocks.dtw_bound(x, y) <= d + 1e-9).all()
        pairs = blocks.dtw_pairs(np.repeat(x, 10, 0), np.tile(y, (12, 1)), np.full(120, np.inf)).reshape(12, 10)
        assert np.allclose(pairs, d)


def test_warped_neighbours_work_out_fewer_pairs():
    rng = np.random.default_rng(8)
    x, y = (rng.normal(size=(n, 20)) * 0.3 + rng.integers(0, 6, (n, 1)) * 3 for n in (30, 200))
    found, count = blocks.dtw_filtered(x, y, 3, None)
    d = blocks.dtw(x, y)
    assert (np.argsort(found, axis=1, kind="stable")[:, :3] == np.argsort(d, axis=1, kind="stable")[:, :3]).all()
    assert count < 30 * 200 / 3


def test_neighbours_of_ragged_and_null_series(spark):
    rng = np.random.default_rng(9)
    rows = [(i, i % 3, rng.normal(size=4 + i % 3).tolist()) for i in range(20)] + [(30, 1, None), (31, 2, []), (32, None, [1.0, 1.0, 1.0, 1.0])]
    series = spark.createDataFrame(rows, "series_id long, label int, v array<double>")
    held = [(i, np.array(v)) for i, _, v in rows if v]
    for name, measure in (("euclid", blocks._euclid), ("dtw", blocks.dtw)):
        got = {(r.series_id, r.place): (r.other_id, round(r.dist, 6)) for r in blocks.nearest(series, series, 2, True, measure).collect()}
        for i, x in held:
            near = sorted((round(float(measure(x[None], y[None])[0, 0]), 9), j) for j, y in held if j != i and (name == "dtw" or len(x) == len(y)))[:2]
            assert [got[i, p + 1] for p in range(len(near))] == [(j, round(d, 6)) for d, j in near]
        assert {i for i, _ in got} == {i for i, _ in held}


def test_a_stream_meets_more_than_a_block_of_candidates(spark, tmp_path, monkeypatch):
    series = spark.createDataFrame([(i, i % 2, [float((i * j) % 5) for j in range(12)]) for i in range(8)], "series_id long, label int, v array<double>")
    series.write.parquet(str(tmp_path / "in"))
    cands = distance.candidates(series, (4,))
    want = {(r.cand_id, r.series_id, round(r.dist, 9), r.pos) for r in distance.min_distances(series, cands, False).collect()}
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 100)
    q = stream_distances(spark.readStream.schema(series.schema).parquet(str(tmp_path / "in")), cands).writeStream.format("memory").queryName("many").start()
    try:
        q.processAllAvailable()
        got = spark.sql("select * from many")
        assert {(r.cand_id, r.series_id, round(r.dist, 9), r.pos) for r in got.collect()} == want and got.where(F.col("cand_id").isNull()).count() == 0
    finally:
        q.stop()
