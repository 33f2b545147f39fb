import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import arrays as A
from seriesloom.operators import evaluation, extractors, metrics, profile, sax, separability
from seriesloom.operators.blocks import dtw
from seriesloom.operators.distance import candidates, features, min_distances, min_distances_declarative
from seriesloom.operators.estimators import DtwNeighbours, ShapeletTree
from seriesloom.operators.extractors import Brute, Learned, Sax, rank, without_overlap
from seriesloom.plans import oracles, queries
from seriesloom.sources import series as S

SF = "/root/testdata/sf0.001"
STEP = [(-1, 1, 0), (1, -1, 0), (-1, -1, 1), (1, 1, 1)]


@pytest.fixture(scope="module")
def steps(spark):
    rows = [(i, c, [0.0] * 2 + [float(a)] * 8 + [0.0] * 5 + [float(b)] * 8 + [0.0] * 2) for i, (a, b, c) in enumerate(STEP)]
    return spark.createDataFrame(rows, "series_id long, label int, v array<double>")


def cand(spark, values):
    return spark.createDataFrame([(0, 0, 0, len(values), [float(x) for x in values])], "cand_id long, series_id long, start_idx int, length int, values array<double>")


def test_known_distances(spark, steps):
    shape = cand(spark, [1, 0, 0, 0, 0, 0, 1])
    z = {r.series_id: (round(r.dist, 6), r.pos) for r in min_distances(steps, shape, True).collect()}
    assert z == {0: (0.842025, 1), 1: (0.842025, 14), 2: (0.842025, 1), 3: (0.0, 9)}
    raw = {r.series_id: (round(r.dist, 6), r.pos) for r in min_distances(steps, shape, False).collect()}
    assert raw == {0: (1.414214, 10), 1: (1.414214, 8), 2: (2.44949, 8), 3: (0.0, 9)}


def test_kernel_equals_expressions(spark, steps):
    cands = candidates(steps, (5,), 3)
    a = {(r.cand_id, r.series_id): (round(r.dist, 6), r.pos) for r in min_distances(steps, cands).collect()}
    b = {(r.cand_id, r.series_id): (round(r.dist, 6), r.pos) for r in min_distances_declarative(steps, cands, 5).collect()}
    assert a == b and len(a) == 4 * 7 * 4


def test_ids_of_windows_of_long_series(spark):
    rows = spark.createDataFrame([(i, i, [float(x % 7) for x in range(1003)]) for i in (1, 2)], "series_id long, label int, v array<double>")
    got = candidates(rows, (2, 3, 1001, 1002)).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cand_id").alias("d")).first()
    assert got.n == got.d == 2 * (1002 + 1001 + 3 + 2)
    assert sorted(r.cand_id for r in candidates(spark.createDataFrame([(5, 0, [1.0] * 17)], rows.schema), (16,)).collect()) == [5016000, 5016001]
    with pytest.raises(ValueError):
        candidates(rows.withColumn("series_id", F.lit(1 << 60)), (2,))


def test_longer_candidate_changes_places_and_empty_series_give_no_row(spark):
    rows = spark.createDataFrame([(1, 0, [2.0, 4.0, 8.0]), (2, 0, []), (3, None, None)], "series_id long, label int, v array<double>")
    got = min_distances(rows, cand(spark, [1, 2, 4, 8, 5, 3])).collect()
    assert [(r.series_id, round(r.dist, 6), r.pos) for r in got] == [(1, 0.0, 0)]


def test_array_functions(spark):
    r = spark.createDataFrame([([2.0, 4.0, 8.0], [1.0, 2.0, 4.0], [3.0, 3.0, 3.0])], "x array<double>, y array<double>, f array<double>").select(
        A.z_norm(F.col("x")).alias("z"), A.z_norm(F.col("f")).alias("flat"), A.pearson(F.col("x"), F.col("y")).alias("rho"), A.pearson(F.col("x"), F.col("f")).alias("none"), A.barycenter(F.col("x"), F.slice("y", 1, 2)).alias("b")
    ).first()
    assert np.allclose(r.z, [-1.069045, -0.267261, 1.336306], atol=1e-6) and r.flat == [0, 0, 0]
    assert math.isclose(r.rho, 1) and abs(r.none) < 1e-12 and r.b == [1.5, 3.0, 8.0]


LINE = [0.0, 0.1, 0.15, 0.3, 0.45, 0.55, 0.7, 0.75, 0.9, 0.95]


def test_scores_of_order_lines(spark):
    rows = [("good", d, int(i > 4)) for i, d in enumerate(LINE)] + [("avg", d, int(i > 5 or i == 4)) for i, d in enumerate(LINE)]
    rows += [("bad", d, i % 2) for i, d in enumerate(LINE)] + [("tied", 1.0, i % 2) for i in range(3)]
    line = spark.createDataFrame(rows, "cand string, dist double, label int")
    ig = {r.cand: (r.score, r.gap, r.tau) for r in metrics.scores(line, "ig").collect()}
    assert ig["good"] == (0.693147, 0.57, 0.5) and ig["avg"][0] == 0.42281 and ig["bad"] == (0.074882, 0.538889, 0.05) and ig["tied"] == (None, None, None)
    assert {r.cand: r.score for r in metrics.score(line, "kw").collect() if r.cand != "tied"} == {"good": 6.818182, "avg": 5.770909, "bad": 0.272727}
    assert {r.cand: r.score for r in metrics.score(line, "f").collect() if r.cand != "tied"} == {"good": 28.5, "avg": 16.621302, "bad": 0.158824}
    assert {r.cand: r.score for r in metrics.score(line, "mm").collect() if r.cand != "tied"} == {"good": 6.4, "avg": 1.6, "bad": 0.0}
    bound = {r.cand: r.bound for r in metrics.gain_bound(line, 0.0).collect()}
    assert all(math.isclose(bound[c], ig[c][0], abs_tol=2e-6) for c in ("good", "avg", "bad"))
    with pytest.raises(KeyError):
        metrics.score(line, "other")


def test_sax(spark):
    ramp = spark.createDataFrame([(0, 0, [float(i) for i in range(16)])], "series_id long, label int, v array<double>")
    z = A.z_norm(F.col("v"))
    r = ramp.select(sax.paa(z, 16, 4).alias("tail"), sax.paa(z, 16, 4, False).alias("plain")).first()
    assert np.allclose(r.tail, [-1.301583, -0.433861, 0.433861, 0.867722], atol=1e-6) and math.isclose(r.plain[3], 1.301583, abs_tol=1e-6)
    assert sax.words(ramp, 16, 4, 4).first().word == [0, 1, 2, 3]
    assert sax.random_masks(8, 3, 5) == sax.random_masks(8, 3, 5)
    with pytest.raises(ValueError):
        sax.words(ramp, 4, 8)


def test_matrix_profile_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 40))
    rows = spark.createDataFrame([(7, x.tolist())], "seq_id long, v array<array<double>>")
    got = {(r.k, r.pos): (r.profile, r.nearest) for r in profile.matrix_profile(rows, 6, spread=3).collect()}
    w = np.lib.stride_tricks.sliding_window_view(x, 6, axis=1)
    z = (w - w.mean(-1, keepdims=True)) / w.std(-1, keepdims=True)
    for p in range(35):
        d = ((z[:, p : p + 1] - z) ** 2).sum(-1)
        d.sort(axis=0)
        for k in (1, 2):
            m = np.sqrt(d[:k].mean(axis=0))
            m[max(0, p - 3) : p + 3] = np.inf
            assert math.isclose(got[k, p][0], m.min(), abs_tol=1e-6) and got[k, p][1] == m.argmin()
    assert profile.motifs(profile.matrix_profile(rows, 6)).count() == 2


def test_dtw(spark):
    def slow(a, b):
        d = np.full((len(a) + 1, len(b) + 1), np.inf)
        d[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j + 1], d[i + 1, j], d[i, j])
        return math.sqrt(d[-1, -1])

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(3, 7)), rng.normal(size=(2, 9))
    assert np.allclose(dtw(x, y), [[slow(a, b) for b in y] for a in x])


def test_extractors_separate_sines(spark):
    t = np.arange(0, 1640, 40)
    wave = np.sin(2 * np.pi * 5 * t / 8000)
    shift = np.sin(2 * np.pi * 5 * t / 8000 + np.pi)
    rows = spark.createDataFrame([(i, c, v.tolist()) for i, (c, v) in enumerate([(0, wave), (0, -abs(shift)), (1, shift), (1, abs(shift))])], "series_id long, label int, v array<double>")
    best = Brute(10, 14, step=2).extract(rows, 3).collect()
    assert len(best) == 3 and best[0].score >= best[1].score >= best[2].score
    kept = without_overlap(rank(candidates(rows, (10,), 1), rows), 5).collect()
    for i, a in enumerate(kept):
        assert not any(b.series_id == a.series_id and b.start_idx <= a.start_idx < b.start_idx + b.length for b in kept[:i])
    assert Sax(lengths=(16,), per_length=4).extract(rows, 2).count() == 2
    losses = Learned(length=10, shapelets=2, steps=6).fit(rows)[3]
    assert losses[-1] < losses[0]
    tree = ShapeletTree(Brute(10, 11, step=2)).fit(rows)
    assert evaluation.accuracy(tree.predict(rows)).first().accuracy >= 0.75 and len(tree.shapelets()) >= 1
    assert evaluation.accuracy(DtwNeighbours(1).fit(rows).predict(rows)).first().accuracy == 1.0


def test_overlaps_beyond_a_thousand_windows(spark):
    # 3840 windows start inside the best one; the next two that don't are worse than all of them.
    rows = [(0, 1, 0, 64, 2.0, 0.0)] + [(1 + i, 1, i % 64, 4 + i // 64, 1.0, 0.0) for i in range(3840)] + [(9000, 1, 64, 8, 0.5, 0.0), (9001, 1, 70, 8, 0.4, 0.0), (9002, 1, 72, 8, None, None), (9003, 2, 0, 8, 0.3, 0.0)]
    ranked = spark.createDataFrame(rows, "cand_id long, series_id long, start_idx int, length int, score double, gap double")
    assert [r.cand_id for r in without_overlap(ranked, 4).collect()] == [0, 9000, 9003, 9002]
    assert [r.cand_id for r in without_overlap(ranked, 2).collect()] == [0, 9000]


def test_swarm_of_lengths(monkeypatch):
    scored, leaders, towards = [], {}, extractors.Swarm._towards

    def fitness(series, arrays, metric, normalize):
        fit = np.array([-abs(len(p) - 9) - float(p @ p) for p in arrays])
        for f, p in zip(fit, arrays, strict=True):
            scored.append((f, p.tobytes()))
            if f > leaders.get(len(p), (-np.inf,))[0]:
                leaders[len(p)] = f, p.tobytes()
        return fit

    goals = []

    def watched(x, goal):
        goals.append(len(x) not in leaders or goal.tobytes() == leaders[len(x)][1])
        return towards(x, goal)

    rng = np.random.default_rng(0)
    monkeypatch.setattr(extractors, "_fitness", fitness)
    monkeypatch.setattr(extractors, "sample_windows", lambda *a: [rng.normal(size=n) for n in (6, 9, 12, 9, 15, 7)])
    monkeypatch.setattr(extractors, "_result", lambda series, arrays, *a: arrays)
    monkeypatch.setattr(extractors.Swarm, "_towards", staticmethod(watched))
    found = extractors.Swarm(particles=6, iterations=12, wait=12, min_len=5, max_len=16, vary_length=True).extract(None, 6)
    # The best that was scored is the result, and every particle follows the best of its length.
    assert found[0].tobytes() == max(scored)[1] and {p.tobytes() for p in found} <= {p for _, p in scored}
    assert all(goals[1::2])


def test_constant_features(spark):
    rows = spark.createDataFrame([(i, i % 3, [8.94427191] * 3) for i in range(27)], "series_id long, label int, v array<double>")
    assert separability.davies_bouldin(rows).first().dbi == math.inf
    assert separability.bhattacharyya(rows).first().coefficient == 1.0


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "Toy_train.csv").write_text("a,b,target\n1,2,x\n3,4,y\n")
    (tmp_path / "Toy_test.csv").write_text("a,b,target\n5,6,x\n7,8,z\n")
    wide = S.read_wide_csv(spark, str(tmp_path / "*.csv"))
    assert {(r.split, r.n_samples, r.n_features, r.n_classes) for r in S.catalogue(wide).collect()} == {("train", 2, 2, 2), ("test", 2, 2, 2)}
    dense = S.densify(wide, wide.where(F.col("file").contains("train")))
    assert {(r.raw_label, r.label) for r in dense.collect()} == {("x", 0), ("y", 1), ("z", None)}
    (tmp_path / "shapes.txt").write_text("[ 1.5 2.  3\n 4.]\n[5, 6.25]")
    assert [r["values"] for r in S.read_shapelet_text(spark, str(tmp_path / "shapes.txt")).orderBy("rank").collect()] == [[1.5, 2, 3, 4], [5, 6.25]]


def test_features_and_stream(spark, steps, tmp_path):
    from seriesloom.streaming.transform import stream_distances

    shape = cand(spark, [1, 0, 0, 0, 0, 0, 1])
    steps.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(steps.schema).parquet(str(tmp_path / "in"))
    q = stream_distances(stream, shape).writeStream.format("memory").queryName("dists").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dists").count() == 4
    assert [len(r.features) for r in features(min_distances(steps, shape)).collect()] == [1] * 4


def test_wilcoxon(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 1.0), (5.0, 5.0), (9.0, 4.0)], "a double, b double")
    r = evaluation.wilcoxon(rows, "a", "b").first()
    assert (r.n, r.w_plus, r.w_minus, r.statistic) == (3, 5.0, 1.0, 1.0)


@pytest.mark.parametrize("name", ["sdist_matrix", "ig_scores", "f_scores", "kw_scores", "mood_scores", "topk_shapelets", "topk_no_overlap", "profile_two_dims", "brute_topk", "fast_topk", "mass_profile", "sax_distance", "sax_words", "scatter_ratio", "matrix_profile", "customer_series", "wilcoxon"])
def test_against_sql(spark, name):
    frame = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("embeddings", "events", "orders", "customer"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(oracles.ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, frame.select(*columns).collect()))) == sorted(map(repr, want.select(",".join(columns)).fetchall()))


def test_pairs_of_blocks_give_what_one_block_gives(spark, monkeypatch):
    from seriesloom.operators import blocks

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, i % 3, rng.normal(size=20).tolist()) for i in range(40)], "series_id long, label int, v array<double>")
    cands = candidates(rows.where("series_id < 9"), (5, 9), 4)
    near = lambda: sorted(map(tuple, blocks.nearest(rows, rows, 3, same=True).collect()))
    dist = lambda: sorted((r.cand_id, r.series_id, r.label, round(r.dist, 9), r.pos) for r in min_distances(rows, cands).collect())
    one = near(), dist()
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 150)
    assert blocks.parts_of(rows) > 3 and (near(), dist()) == one


def test_gain_bound_by_brute_force(spark):
    rng = np.random.default_rng(6)
    lines = {c: [(float(np.round(rng.random(), 1 + c % 2)), int(rng.integers(0, 2 + c % 3))) for _ in range(25)] for c in range(9)} | {99: [(0.5, 0), (0.5, 1)]}
    frame = spark.createDataFrame([(c, d, k) for c, xs in lines.items() for d, k in xs], "cand long, dist double, label int")
    entropy = lambda counts: -sum(x / sum(counts) * math.log(x / sum(counts)) for x in counts if x)
    got = {r.cand: r.bound for r in metrics.gain_bound(frame, 0.15).collect()}
    for c, xs in lines.items():
        labels, best, at = sorted({k for _, k in xs}), 0.0, sorted({d for d, _ in xs})
        for a, b in zip(at, at[1:]):
            tau = (a + b) / 2
            left = {k: sum(d <= a and x == k for d, x in xs) for k in labels}
            right = {k: sum(d > a and x == k for d, x in xs) for k in labels}
            n, m = sum(left.values()), sum(right.values())
            sure = {x: left[x] * m - right[x] * n for x in labels}
            new_left = dict(left)
            for d, k in xs:
                if sure[k] < 0 and tau - 0.15 <= d <= a:
                    new_left[k] -= 1
                if sure[k] > 0 and a < d <= tau + 0.15:
                    new_left[k] += 1
            new_right = {k: left[k] + right[k] - new_left[k] for k in labels}
            parts = [list(x.values()) for x in (new_left, new_right) if sum(x.values())]
            best = max(best, entropy([left[k] + right[k] for k in labels]) - sum(sum(p) / len(xs) * entropy(p) for p in parts))
        assert math.isclose(got[c], best, abs_tol=2e-6), (c, got[c], best)


def test_running_sums(spark):
    from seriesloom.operators import blocks, sums

    rng = np.random.default_rng(8)
    x, y = rng.normal(size=11), rng.normal(size=14)
    for length in (2, 5, 11):
        want = [[np.corrcoef(x[i : i + length], y[j : j + length])[0, 1] for j in range(len(y) - length + 1)] for i in range(len(x) - length + 1)]
        assert np.allclose(sums.correlations(x, y, length), want)
    assert (sums.correlations(np.ones(6), y, 4) == 0).all()
    rows = spark.createDataFrame([(i, i % 2, rng.normal(size=12 + i % 3).tolist()) for i in range(9)] + [(20, 1, []), (21, 0, None)], "series_id long, label int, v array<double>")
    line = lambda d: sorted((r.cand_id, r.series_id, r.label, round(r.dist, 6), r.pos) for r in d.collect())
    want = line(min_distances(rows, candidates(rows, range(5, 9))))
    assert line(sums.window_distances(rows, range(5, 9))) == want
    old, blocks.PAIR_ROWS = blocks.PAIR_ROWS, 40
    try:
        assert line(sums.window_distances(rows, range(5, 9))) == want
    finally:
        blocks.PAIR_ROWS = old
    fine = rows.where("size(v) > 0")
    assert [tuple(r) for r in extractors.Fast(5, 9).extract(fine, 4).collect()] == [tuple(r) for r in Brute(5, 9).extract(fine, 4).collect()]


def test_alignment_kernel_by_all_paths():
    from seriesloom.operators import alignment

    def slow(x, y, width):
        def walk(i, j):
            e = math.exp(-((x[i] - y[j]) ** 2) / (2 * width**2))
            before = 1.0 if i == j == 0 else sum(walk(a, b) for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a >= 0 and b >= 0)
            return e / (2 - e) * before

        return walk(len(x) - 1, len(y) - 1)

    rng = np.random.default_rng(1)
    xs, ys = [rng.normal(size=n) for n in (3, 4)], [rng.normal(size=n) for n in (2, 4, 5)]
    assert np.allclose([[math.exp(alignment.log_kernel(x, y, 0.8)) for y in ys] for x in xs], [[slow(x, y, 0.8) for y in ys] for x in xs])
    assert np.allclose(np.diag(alignment.similarities(xs, xs, 0.8)), 1)
    assert alignment.barycenter(np.array([2.0, 4.0, 8.0]), np.array([1.0, 2.0])).tolist() == [1.5, 3.0, 8.0]
    one, two = alignment.blended([xs[0]], [xs[0], xs[0] + 0.5])
    assert np.allclose(one[0], xs[0] + 0.25) and np.allclose(two[1], xs[0] + 0.25) and np.allclose(two[0], xs[0])


def test_learning_of_several_lengths(spark, steps):
    blocks, w, b, losses = Learned(sizes={4: 2, 7: 1}, steps=8).fit(steps)
    assert [x.shape for x in blocks] == [(2, 4), (1, 7)] and w.shape == (3, 2) and losses[-1] < losses[0]
    # The gradient against differences of the loss.
    model, rng = Learned(), np.random.default_rng(0)
    w, b = rng.normal(size=w.shape), rng.normal(size=b.shape)
    total = lambda bs, ws: np.array([r.t for r in model._gradient(steps, bs, ws, b).groupBy("at").agg(F.sum("value").alias("t")).orderBy("at").collect()])
    base = total(blocks, w)
    for k in (0, 1):
        moved = [x.copy() for x in blocks]
        moved[k][0, 1] += 1e-5
        at = 2 + sum(x.size for x in blocks[:k]) + 1
        assert math.isclose((total(moved, w)[1] - base[1]) / 1e-5, base[at], rel_tol=1e-2, abs_tol=1e-3)


def test_sinks_bootstrap_and_sizes(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("series_id"), F.lit(1).alias("label"))
    times = {r.series_id: r["count"] for r in S.bootstrap(rows).groupBy("series_id").count().collect()}
    assert times == {r.series_id: r["count"] for r in S.bootstrap(rows).groupBy("series_id").count().collect()}
    assert sum(times.values()) == 2000 and abs(len(times) - 2000 * (1 - math.exp(-1))) < 100
    assert S.bootstrap(rows, 0.0).count() == 0 and S.bootstrap(rows.limit(0)).count() == 0
    S.write_predictions(spark.createDataFrame([(0, 1), (1, 3)], "row_id long, prediction int"), str(tmp_path / "p"))
    assert {(r.row_id, r.prediction) for r in S.read_predictions(spark, str(tmp_path / "p")).collect()} == {(0, 1), (1, 3)}
    S.write_runtime(spark, 2.5, str(tmp_path / "t"))
    assert [r.seconds for r in S.read_runtimes(spark, str(tmp_path / "t")).collect()] == [2.5]
    for a in (0.1, 0.2):
        S.write_measurements(spark.createDataFrame([(a, 0.9)], "rate double, accuracy double"), str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2
    found = spark.createDataFrame([("a", [1.0] * 4), ("a", [1.0] * 6), ("b", [1.0] * 4), ("b", [2.0] * 4)], "file string, values array<double>")
    sizes = S.sizes_of(found)
    assert sum(sizes.values()) == 2 and set(sizes) <= {4, 6} and S.sizes_of(found.limit(0)) == {}


def test_distance_profile(spark):
    from seriesloom.operators.sums import distance_profile

    rng = np.random.default_rng(4)
    x, q = rng.normal(size=30), rng.normal(size=6)
    x[10:17] = 2.0
    rows = spark.createDataFrame([(1, x.tolist()), (2, [1.0]), (3, None)], "seq_id long, v array<double>")
    z = lambda v: (v - v.mean()) / (v.std() or 1) if len(set(v)) > 1 else v * 0
    got = [r.dist for r in distance_profile(rows, q).orderBy("pos").collect()]
    assert np.allclose(got, [np.linalg.norm(z(x[i : i + 6]) - z(q)) for i in range(25)])
