"""Steps whose state the driver holds."""

import math

import pytest
from pyspark.sql import functions as F

from seriesloom.llm import mixing, quality


def test_held_tilts_and_models_are_those_of_tables_in_few_jobs(spark):
    """with few sources and pools the driver holds the state between steps; the results are those of the tables, and no step stores one."""
    histogram = spark.createDataFrame([(s, size, 1 + (size * 7 + len(s or "")) % 5) for s in ("a", "bb", "ccc", None) for size in range(1, 200)], "source string, size bigint, documents bigint")
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size"))
    targets = mixing.source_targets(sizes).localCheckpoint()
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    rates, models = {}, {}
    x = spark.range(4000).select(
        F.concat(F.lit("pool"), F.col("id") % 3).alias("pool"),
        *[((F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 500.0 - 1) * (i + 1) + F.when(F.col("id") % 10 == 0, 5.0).otherwise(0.0)).alias(f"x{i}") for i in range(4)],
    ).localCheckpoint()
    for held in (1_000, 1):
        group = f"held-{held}"
        spark.sparkContext.setJobGroup(group, group)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(mixing, "HELD", held)
            patch.setattr(quality, "HELD", held)
            rates[held] = {r.source: (r["lambda"], r.target, r["mean"], r.full) for r in mixing.tilts(histogram, targets).collect()}
            models[held] = {r.pool: r.asDict() for r in quality.estimate(x).collect()}
        jobs[held] = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    counts = {s: [(r.size, r.documents) for r in histogram.collect() if r.source == s] for s in rates[1]}
    for source, (tilt, target, mean, full) in rates[1_000].items():
        assert full == rates[1][source][3]
        if not full:
            words = sum(n * size * min(3.0, math.exp(tilt * size / mean)) for size, n in counts[source])
            assert words == pytest.approx(target, rel=2e-9) and tilt == pytest.approx(rates[1][source][0], abs=1e-6)
    assert models[1_000].keys() == models[1].keys()
    for pool, one in models[1_000].items():
        assert all(one[c] == pytest.approx(v, rel=1e-7, abs=1e-9) for c, v in models[1][pool].items() if c != "pool")
    assert jobs[1_000] * 3 < jobs[1]
