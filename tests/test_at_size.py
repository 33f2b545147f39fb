"""What only larger tables show: near ties, tables of several blocks, jobs whose work went up with the square of their rows."""

import datetime

import duckdb
import numpy as np
import pytest

from seriesloom.plans import oracles, queries


def against_sql(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(oracles.ORACLES[name])
    frame = queries.queries()[name](spark, str(folder))
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    got = sorted(map(repr, map(tuple, frame.select(*columns).collect())))
    assert got == sorted(map(repr, want.select(",".join(columns)).fetchall())) and got


def write_events(spark, folder, series):
    """events of series {user: values of the first days}, one a day."""
    start = datetime.datetime(2024, 1, 1, 12)
    rows = [(i, u, start + datetime.timedelta(days=d), float(x)) for i, (u, d, x) in enumerate((u, d, x) for u, v in series.items() for d, x in enumerate(v) if x)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").write.parquet(f"{folder}/events.parquet")


def test_profiles_that_agree_to_six_digits_are_ties(spark, tmp_path):
    """Windows 8 and 17 are equally far from window 1 by the six digits of the SQL, not by nine."""
    v = [188.1, 186.23, 210.84, 90.43, 121.86, 259.58, 106.32, 160.86, 59.53, 73.59, 56.07, 70.13, 141.81, 0, 134.35, 34.28, 45.01, 137.71, 51.48, 18.79, 84.01, 482.73, 157.17, 181.54, 56.53, 37.78, 102.28, 282.14, 96.23, 0]
    write_events(spark, tmp_path, {3: v, 4: v[::-1]})
    against_sql(spark, tmp_path, "matrix_profile", ["events"])


@pytest.mark.parametrize("name", ["nearest_neighbour", "separability_index"])
def test_neighbours_of_a_table_of_several_blocks(spark, tmp_path, monkeypatch, name):
    """One table on both sides, in more than one block: the two sides of a pair of blocks must keep their own columns."""
    from seriesloom.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_VALUES", 200)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) + 3 * (i % 3)).tolist(), i % 3) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    against_sql(spark, tmp_path, name, ["embeddings"])


def searched(spark):
    """Series of several lengths and three classes, some flat, one with a spike."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(40):
        v = np.round(rng.normal(size=12 + 3 * (i % 3)), 2) * (i % 7 > 0)
        v[4:8] += (i % 3) * np.array([0, 3, 3, 0])
        rows.append((i, i % 3, v.tolist()))
    rows[5][2][3] = 1e7
    return spark.createDataFrame([*rows, (90, 1, None), (91, 0, [])], "series_id long, label int, v array<double>")


@pytest.mark.parametrize("normalize", [True, False])
def test_lines_scored_in_tasks_are_those_of_sql(spark, monkeypatch, normalize):
    from seriesloom.operators import lines
    from seriesloom.operators.distance import candidates
    from seriesloom.operators.extractors import rank

    series = searched(spark)
    # Lengths 13 and 14 are longer than some series.
    cands = candidates(series, (5, 13, 14), 2)
    read = lambda: sorted((r.cand_id, r.score, r.gap, r.tau) for r in rank(cands, series, "ig", normalize).collect())
    assert lines.parts(series, cands) == 0
    want = read()
    monkeypatch.setattr(lines, "ROWS", 0)
    for name, value in (("LINES", 1 << 21), ("LINES", 100), ("SCORED", 90), ("CELLS", 64)):
        monkeypatch.setattr(lines, name, value)
    assert lines.parts(series, cands) > 0
    got = read()
    assert len(got) == len(want) > 100
    for x, y in zip(got, want, strict=True):
        assert x[0] == y[0] and np.allclose(x[1:], y[1:], atol=2e-6, rtol=1e-9), (x, y)


def test_running_sums_of_a_block_of_series_are_those_of_pairs(spark, monkeypatch):
    from seriesloom.operators import lines
    from seriesloom.operators.extractors import Fast

    series = searched(spark)
    want = [tuple(r) for r in Fast(4, 14).extract(series, 30).drop("values").collect()]
    for name, value in (("ROWS", 0), ("LINES", 150), ("CELLS", 700)):
        monkeypatch.setattr(lines, name, value)
    monkeypatch.setattr("seriesloom.operators.extractors.window_distances", None)
    assert [tuple(r) for r in Fast(4, 14).extract(series, 30).drop("values").collect()] == want


def test_lines_beyond_what_is_held_go_by_rows(spark, monkeypatch):
    from seriesloom.operators import lines
    from seriesloom.operators.distance import candidates

    monkeypatch.setattr(lines, "ROWS", 0)
    series = searched(spark)
    cands = candidates(series, (4,))
    assert lines.parts(series, cands)
    gap = spark.createDataFrame([(95, 1, [1.0, None, 2.0, 4.0, 5.0])], series.schema)
    assert not lines.parts(series.union(gap), cands) and not lines.parts(series, candidates(gap, (4,)))
    assert not lines.parts(series.union(spark.createDataFrame([(96, None, [1.0, 2.0])], series.schema)), cands)
    monkeypatch.setattr(lines, "HELD", 100)
    assert not lines.parts(series, cands)


def test_a_tree_of_lines_scored_in_tasks(spark, monkeypatch):
    from seriesloom.operators import estimators, lines
    from seriesloom.operators.extractors import Brute

    series = searched(spark).where("v IS NOT NULL")
    grown = lambda: sorted((n.path, n.values, n.tau, sorted(n.probabilities.items())) for n in estimators.ShapeletTree(Brute(5, 7), max_depth=2).fit(series).nodes)
    want = grown()
    monkeypatch.setattr(lines, "ROWS", 0)
    met = []
    whole = estimators.min_distances
    monkeypatch.setattr(estimators, "min_distances", lambda series, cands, *a: met.append(cands.count()) or whole(series, cands, *a))
    # Only the best window of each node becomes rows.
    assert grown() == want and len(want) >= 3 and max(met) <= 2


def test_a_pruned_search_has_rows_of_its_references_only(spark, monkeypatch):
    from seriesloom.operators import lines, pruned

    series = searched(spark)
    names = ("cand_id", "score", "gap", "tau")
    want = [[r[c] for c in names] for r in pruned.Pruned(5, 7, batch=64).extract(series, 3).collect()]
    monkeypatch.setattr(lines, "ROWS", 0)
    monkeypatch.setattr(pruned, "REFERENCES", 9)
    met = []
    whole = pruned.min_distances
    monkeypatch.setattr(pruned, "min_distances", lambda series, cands, *a: met.append(cands.count()) or whole(series, cands, *a))
    search = pruned.Pruned(5, 7, batch=64)
    assert [[r[c] for c in names] for r in search.extract(series, 3).collect()] == want
    assert met and max(met) <= 9 and len(search.rounds) > 1


def test_tiles_of_one_dimension_work_out_few_pairs(monkeypatch):
    """Single precision leaves few pairs to double precision; flat windows, copies and gaps have the nearest of all pairs."""
    from seriesloom.operators import diagonals

    rng = np.random.default_rng(5)
    n, length = 300, 8
    v = np.round(rng.exponential(50, size=2 * n + length - 1), 2)
    v[100:115], v[200:212], v[400:412], v[500] = 7, v[20:32], v[20:32], np.nan
    segments = [diagonals.Segment(v[None, i * n : (i + 1) * n + length - 1], i * n, length) for i in (0, 1)]
    best = [(np.full((1, n), np.inf), np.full((1, n), 1 << 60)) for _ in segments]
    worked = []
    improve = diagonals._improve
    monkeypatch.setattr(diagonals, "_improve", lambda q, *a: worked.append(len(q)) or improve(q, *a))
    for name, value in (("ROWS", 64), ("COLUMNS", 100)):
        monkeypatch.setattr(diagonals, name, value)
    for i, j in ((0, 0), (0, 1), (1, 1)):
        diagonals.compare(segments[i], segments[j], best[i], None if i == j else best[j])
    w = np.lib.stride_tricks.sliding_window_view(np.nan_to_num(v), length)
    bad, flat = np.isnan(np.lib.stride_tricks.sliding_window_view(v, length)).any(1), w.std(1) < 1e-7
    z = (w - w.mean(1, keepdims=True)) / np.maximum(w.std(1, keepdims=True), 1e-7)
    square = 2 * (length - z @ z.T)
    gap = np.arange(2 * n)[None, :] - np.arange(2 * n)[:, None]
    square[(gap >= -4) & (gap < 4) | (bad | flat)[None, :]] = np.inf
    got = np.concatenate([b[0][0] for b in best]), np.concatenate([b[1][0] for b in best])
    assert np.isinf(got[0][bad]).all() and np.allclose(got[0][~bad], square.min(1)[~bad], atol=1e-9)
    assert (got[1][~bad] == np.round(square, 9).argmin(1)[~bad]).all()
    assert 0 < sum(worked) < (2 * n) ** 2 / 8


def test_gain_bound_takes_running_counts(spark):
    """No frame over distances, whose rows would be gone over again for every cut."""
    from seriesloom.operators.metrics import gain_bound

    rng = np.random.default_rng(8)
    line = spark.createDataFrame([(c, float(np.round(rng.random() + 0.1 * (i % 3), 3)), i % 3) for c in (4, 9) for i in range(400)], "cand long, dist double, label int")
    found = gain_bound(line, 0.05)
    assert "Window" not in found._jdf.queryExecution().toString()
    con = duckdb.connect()
    dm = line.toPandas()  # noqa: F841
    sql = oracles._BOUND.replace(oracles._DM, "dm AS (SELECT cand, dist, label FROM held)")
    con.register("held", dm)
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(sql).fetchall())


def test_nearest_rows_from_products_in_single_precision(monkeypatch):
    """The nearest by differences, ties by id, with copies, large offsets and values that are not finite; few pairs are worked out."""
    from seriesloom.operators import blocks

    rng = np.random.default_rng(3)
    monkeypatch.setattr(blocks, "OTHERS", 100)
    for case in range(4):
        y = rng.normal(size=(700, 6)) + (1e6 if case == 1 else 0)
        if case == 2:
            y = np.round(y)
            y[50:300] = y[7]
        if case == 3:
            y[5], y[9], y[11] = 1e12, np.nan, 1e200
        ids = rng.permutation(700) * 3
        rows = rng.permutation(700)[:80]
        for k, own in ((1, None), (3, ids[rows])):
            got = [(int(i), int(j)) for i, j, _ in zip(*blocks.least(y[rows], y, ids, k, own), strict=True)]
            want = []
            for i, r in enumerate(rows):
                with np.errstate(over="ignore"):
                    d = np.round(np.sqrt(((y[r] - y) ** 2).sum(1)), 9)
                d[~np.isfinite(d)] = np.inf
                if own is not None:
                    d[r] = np.inf
                want += [(i, int(j)) for j in np.lexsort((ids, d))[:k] if np.isfinite(d[j])]
            assert got == want, (case, k)
    x, y = rng.normal(size=(100, 16)), rng.normal(size=(2000, 16))
    pairs = blocks._candidates(x, y, 1, (np.zeros(0, np.int64),) * 2, np.float32)
    assert 100 <= len(pairs[0]) < 100 * 20


def test_a_query_goes_to_a_group_of_blocks_once(spark, monkeypatch):
    from seriesloom.operators import balls

    rng = np.random.default_rng(1)
    v = np.cumsum(rng.exponential(size=(150, 6)) * rng.exponential(size=(150, 1)), axis=1)
    rows = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)], "series_id long, label int, v array<double>").repartition(3)
    monkeypatch.setattr(balls, "GROUP", 64)
    sent = []
    reached = balls.Balls._reached

    def noted(self, *a):
        found = reached(self, *a)
        sent.append([(r.row, r.group, len(r.to)) for r in found.collect()])
        return found

    monkeypatch.setattr(balls.Balls, "_reached", noted)
    got = {(r.series_id, r.place): r.other_id for r in balls.ball_neighbours(rows, k=2, block=8).collect()}
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 9)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, place + 1): int(j) for i in range(150) for place, j in enumerate(np.argsort(d[i], kind="stable")[:2])}
    # Fewer rows than blocks that are met.
    assert len({s[:2] for s in sent[0]}) == len(sent[0]) < sum(s[2] for s in sent[0]) / 2
