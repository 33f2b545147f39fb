"""Profiles of long sequences by tiles against the profile by all pairs, and rows numbered without a task that sees them all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators.diagonals import long_profile
from seriesloom.operators.profile import matrix_profile
from seriesloom.sources import series as S


def compared(spark, sequences, length, block):
    rows = [(s, p, [None if e is None else float(e) for e in x]) for s, v in sequences.items() for p, x in enumerate(v)]
    points = spark.createDataFrame(rows, "seq_id long, pos long, x array<double>").repartition(3)
    whole = spark.createDataFrame([(s, [[None if x[d] is None else float(x[d]) for x in v] for d in range(len(v[0]))]) for s, v in sequences.items()], "seq_id long, v array<array<double>>")
    got = {(r.seq_id, r.k, r.pos): (r.profile, r.nearest) for r in long_profile(points, length, block).collect()}
    want = {(r.seq_id, r.k, r.pos): (r.profile, r.nearest) for r in matrix_profile(whole, length).collect()}
    assert got.keys() == want.keys()
    for key, (profile, nearest) in want.items():
        assert (profile is None) == (got[key][0] is None), key
        if profile is not None:
            assert abs(profile - got[key][0]) < 1e-5 and got[key][1] == nearest, (key, profile, nearest, got[key])


def test_tiles_agree_with_all_pairs(spark):
    rng = np.random.default_rng(4)
    walk = rng.normal(size=(260, 2)).cumsum(0) * 0.1 + rng.normal(size=(260, 2))
    walk[40:60] = 1.5
    rows = walk.tolist()
    rows[120][0] = None
    rows[200][1] = float("nan")
    compared(spark, {3: rows, 9: rng.normal(size=(31, 2)).tolist(), 11: rng.normal(size=(7, 2)).tolist()}, 8, 37)


@pytest.mark.parametrize("spike", [1e4, 1e6, 1e9])
def test_what_comes_after_a_spike_keeps_its_digits(spark, spike):
    rng = np.random.default_rng(7)
    v = 0.1 * rng.normal(size=(150, 1)) + 5
    v[20] = spike
    compared(spark, {1: v.tolist()}, 8, 64)


def test_short_windows_and_sequences(spark):
    points = spark.createDataFrame([(1, p, [1.0]) for p in range(3)], "seq_id long, pos long, x array<double>")
    assert long_profile(points, 4).count() == 0 and long_profile(points.where("false"), 4).count() == 0
    with pytest.raises(ValueError):
        long_profile(points, 3)


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 100).alias("a"), "id").repartition(7)
    got = [(r.a, r.id, r.pos) for r in S.numbered(rows, "a", "id").orderBy("pos").collect()]
    assert [p for *_, p in got] == list(range(1000)) and got == sorted(got)
    assert S.numbered(rows.where("false"), "a").count() == 0
