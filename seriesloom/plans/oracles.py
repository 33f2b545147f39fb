"""DuckDB SQL for the queries on series."""

from __future__ import annotations

import re

from ..operators.sax import breakpoints, distance_table
from .queries import MASKS

_S = "s AS (SELECT vec_id AS series_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_P = "pt AS (SELECT series_id, label, unnest(range(len(v))) AS t, unnest(v) AS x FROM s)"


def _cands(step: int = 16) -> str:
    return f"""src AS (SELECT min(series_id) AS series_id FROM s GROUP BY label),
q AS (SELECT s.series_id * 1000000 + 16000 + p AS cand_id, s.series_id, CAST(p AS INTEGER) AS start_idx, v[p+1:p+16] AS q FROM s JOIN src USING (series_id), (SELECT unnest(range(0, 49, {step})) AS p)),
w AS (SELECT series_id, label, CAST(p AS INTEGER) AS p, v[p+1:p+16] AS w FROM s, (SELECT unnest(range(49)) AS p))"""


def _z(c: str) -> str:
    return f"list_transform({c}, lambda x: (x - list_avg({c})) / CASE WHEN list_stddev_pop({c}) = 0 THEN 1 ELSE list_stddev_pop({c}) END)"


def _dist(normalize: bool = True, step: int = 16) -> str:
    zq, zw = (_z("q"), _z("w")) if normalize else ("q", "w")
    over = "4" if normalize else "1"
    return f"""{_S}, {_cands(step)},
zq AS (SELECT cand_id, series_id AS source, start_idx, {zq} AS z FROM q), zw AS (SELECT series_id, label, p, {zw} AS z FROM w),
d AS (SELECT cand_id, zw.series_id, label, min(list_distance(zq.z, zw.z) / {over}) AS r, min({{'d': round(list_distance(zq.z, zw.z) / {over}, 9), 'p': p}}) AS b FROM zq, zw GROUP BY ALL)"""


_DM = _dist() + ", dm AS (SELECT cand_id AS cand, round(r, 5) AS dist, label FROM d)"


#: Every threshold of a line with all its points: what the range frames of gain_bound give, by a join.
_BOUND = f"""WITH {_DM},
pts AS (SELECT cand, label, dist, count(*) AS w FROM dm GROUP BY 1, 2, 3),
ds AS (SELECT cand, dist, lead(dist) OVER (PARTITION BY cand ORDER BY dist) AS nxt FROM (SELECT DISTINCT cand, dist FROM dm)),
cuts AS (SELECT cand, (dist + nxt) / 2 AS tau FROM ds WHERE nxt IS NOT NULL),
g AS (SELECT c.cand, c.tau, p.label, CAST(sum(w) AS BIGINT) AS n, CAST(sum(CASE WHEN p.dist <= c.tau THEN w ELSE 0 END) AS BIGINT) AS l,
  CAST(sum(CASE WHEN p.dist <= c.tau AND p.dist >= c.tau - 5e-2 THEN w ELSE 0 END) AS BIGINT) AS nl, CAST(sum(CASE WHEN p.dist > c.tau AND p.dist <= c.tau + 5e-2 THEN w ELSE 0 END) AS BIGINT) AS nr
  FROM cuts c JOIN pts p ON p.cand = c.cand GROUP BY 1, 2, 3),
t AS (SELECT *, sum(l) OVER (PARTITION BY cand, tau) AS tl, sum(n - l) OVER (PARTITION BY cand, tau) AS tr FROM g),
m AS (SELECT cand, tau, CAST(n AS DOUBLE) AS n, CAST(CASE WHEN l * tr > (n - l) * tl THEN l + nr WHEN l * tr < (n - l) * tl THEN l - nl ELSE l END AS DOUBLE) AS l FROM t),
h AS (SELECT cand, tau, sum(n) AS n, sum(l) AS l, sum(n - l) AS r, sum(n * ln(n)) AS hn, sum(CASE WHEN l > 0 THEN l * ln(l) ELSE 0e0 END) AS hl, sum(CASE WHEN n > l THEN (n - l) * ln(n - l) ELSE 0e0 END) AS hr FROM m GROUP BY 1, 2)
SELECT cand, round(greatest(0e0, max((n * ln(n) - hn - CASE WHEN l > 0 THEN l * ln(l) ELSE 0e0 END + hl - CASE WHEN r > 0 THEN r * ln(r) ELSE 0e0 END + hr) / n)), 6) AS bound FROM h GROUP BY 1"""


#: Gain, gap and threshold of every cut by a join of cuts and points, from entropies of both sides; the best cut of each line.
_GAIN = """pts AS (SELECT cand, label, dist, CAST(count(*) AS DOUBLE) AS w FROM dm GROUP BY 1, 2, 3),
nexts AS (SELECT cand, dist, lead(dist) OVER (PARTITION BY cand ORDER BY dist) AS nxt FROM (SELECT DISTINCT cand, dist FROM dm)),
cuts AS (SELECT cand, (dist + nxt) / 2 AS tau FROM nexts WHERE nxt IS NOT NULL),
side AS (SELECT c.cand, c.tau, p.dist <= c.tau AS near, p.label, sum(w) AS n, sum(w * p.dist) AS s FROM cuts c JOIN pts p ON p.cand = c.cand GROUP BY 1, 2, 3, 4),
ent AS (SELECT cand, tau, near, sum(n) AS n, sum(s) AS s, -sum(n / tot * ln(n / tot)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY cand, tau, near) AS tot FROM side) GROUP BY 1, 2, 3),
whole AS (SELECT cand, sum(n) AS n, -sum(n / tot * ln(n / tot)) AS h FROM (SELECT cand, label, sum(w) AS n, sum(sum(w)) OVER (PARTITION BY cand) AS tot FROM pts GROUP BY 1, 2) GROUP BY 1),
cut AS (SELECT l.cand, l.tau, round(a.h - (l.n * l.h + r.n * r.h) / a.n, 9) AS gain, round(r.s / r.n - l.s / l.n, 9) AS gap FROM ent l JOIN ent r ON l.cand = r.cand AND l.tau = r.tau AND l.near AND NOT r.near JOIN whole a ON a.cand = l.cand),
best AS (SELECT cand, round(gain, 6) AS gain, round(gap, 6) AS gap, round(tau, 6) AS tau FROM cut QUALIFY row_number() OVER (PARTITION BY cand ORDER BY cut.gain DESC, cut.gap DESC, cut.tau) = 1)"""

#: Variance ratio from the deviations of single points.
_F = """SELECT cand, round((sum((m - g) * (m - g)) / nullif(count(DISTINCT label) - 1, 0)) / nullif(sum((dist - m) * (dist - m)) / nullif(count(*) - count(DISTINCT label), 0), 0e0), 6) AS score
FROM (SELECT cand, label, dist, avg(dist) OVER (PARTITION BY cand, label) AS m, avg(dist) OVER (PARTITION BY cand) AS g FROM dm) GROUP BY 1"""

#: Ranks by counting smaller points; H as the spread of mean ranks about the middle one, over the correction for ties.
_KW = """v AS (SELECT cand, dist, CAST(count(*) AS DOUBLE) AS t FROM dm GROUP BY 1, 2),
rk AS (SELECT a.cand, a.dist, a.t, coalesce(sum(b.t), 0e0) + (a.t + 1) / 2 AS r FROM v a LEFT JOIN v b ON b.cand = a.cand AND b.dist < a.dist GROUP BY 1, 2, 3),
sz AS (SELECT cand, sum(t) AS n, sum(t * t * t - t) AS ties FROM v GROUP BY 1),
mr AS (SELECT dm.cand, label, count(*) AS k, avg(r) AS m FROM dm JOIN rk ON rk.cand = dm.cand AND rk.dist = dm.dist GROUP BY 1, 2)
SELECT mr.cand, round(12 / (max(n) * (max(n) + 1)) * sum(k * (m - (n + 1) / 2) * (m - (n + 1) / 2)) / nullif(1 - max(ties) / nullif(max(n) * max(n) * max(n) - max(n), 0e0), 0e0), 6) AS score FROM mr JOIN sz ON sz.cand = mr.cand GROUP BY 1"""

#: Chi-square of the shares above the median in its form for two rows.
_MOOD = """md AS (SELECT cand, quantile_cont(dist, 0.5) AS mid FROM dm GROUP BY 1),
ab AS (SELECT dm.cand, label, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (dist > mid) AS DOUBLE) AS a FROM dm JOIN md ON md.cand = dm.cand GROUP BY 1, 2),
al AS (SELECT cand, sum(n) AS n, sum(a) AS a, count(*) AS k FROM ab GROUP BY 1),
df AS (SELECT ab.cand, ab.n, al.n AS nn, al.a AS aa, abs(ab.a - ab.n * al.a / al.n) AS d, k FROM ab JOIN al ON al.cand = ab.cand)
SELECT cand, round(sum(power(CASE WHEN k = 2 THEN d - least(5e-1, d) ELSE d END, 2) / n) * max(nn) * max(nn) / nullif(max(aa) * (max(nn) - max(aa)), 0e0), 6) AS score FROM df GROUP BY 1"""

#: The walk over the windows of a series, best first, as a recursion over places.
_WALK = f"""WITH RECURSIVE {_dist(True, 4)}, dm AS (SELECT cand_id AS cand, round(r, 5) AS dist, label FROM d), {_GAIN},
rk AS (SELECT zq.cand_id, zq.source, zq.start_idx, gain, gap, tau, row_number() OVER (PARTITION BY zq.source ORDER BY gain DESC NULLS LAST, gap DESC NULLS LAST, zq.start_idx) AS place FROM zq LEFT JOIN best ON best.cand = zq.cand_id),
walk AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS place, CAST([] AS INTEGER[]) AS kept FROM rk
  UNION ALL SELECT w.source, r.place, CASE WHEN len(kept) < 10 AND len(list_filter(kept, lambda a: a <= r.start_idx AND r.start_idx < a + 16)) = 0 THEN list_append(kept, r.start_idx) ELSE kept END FROM walk w JOIN rk r ON r.source = w.source AND r.place = w.place + 1),
last AS (SELECT source, arg_max(kept, place) AS kept FROM walk GROUP BY 1)
SELECT cand_id, rk.source AS series_id, start_idx, 16 AS length, gain AS score, gap, tau FROM rk JOIN last ON last.source = rk.source AND list_contains(kept, start_idx) ORDER BY gain DESC NULLS LAST, gap DESC NULLS LAST, rk.source, start_idx LIMIT 10"""

#: Two halves of a series as dimensions, every pair of windows.
_TWO = f"""WITH {_S}, w AS (SELECT series_id AS seq_id, CAST(p AS INTEGER) AS p, v[p+1:p+8] AS a, v[p+33:p+40] AS b FROM s, (SELECT unnest(range(25)) AS p)),
z AS (SELECT seq_id, p, {_z("a")} AS a, {_z("b")} AS b FROM w),
d AS (SELECT x.seq_id, x.p, y.p AS q, power(list_distance(x.a, y.a), 2) AS da, power(list_distance(x.b, y.b), 2) AS db FROM z x JOIN z y ON x.seq_id = y.seq_id AND NOT (y.p - x.p >= -4 AND y.p - x.p < 4)),
k AS (SELECT seq_id, 1 AS k, p, q, sqrt(least(da, db)) AS d FROM d UNION ALL SELECT seq_id, 2, p, q, sqrt((da + db) / 2) FROM d)
SELECT seq_id, CAST(k AS INTEGER) AS k, p AS pos, round(min({{'r': round(d, 9), 'q': q, 'd': d}}).d, 6) AS profile, min({{'r': round(d, 9), 'q': q}}).q AS nearest FROM k GROUP BY 1, 2, 3"""


def _words() -> str:
    starts = [(i * 4, i * 4 + 4) for i in range(7)] + [(24, 32)]
    means = ", ".join(f"round(list_avg(z[{a + 1}:{b}]), 9)" for a, b in starts)
    cuts = ", ".join(repr(x) + "::DOUBLE" for x in breakpoints(4))
    return f"""{_S}, w AS (SELECT series_id, label, CAST(p AS INTEGER) AS pos, v[p+1:p+32] AS w FROM s, (SELECT unnest(range(33)) AS p)),
z AS (SELECT series_id, label, pos, {_z('w')} AS z FROM w), m AS (SELECT series_id, label, pos, [{means}] AS m FROM z),
wd AS MATERIALIZED (SELECT series_id, label, pos, list_transform(m, lambda x: len(list_filter([{cuts}], lambda b: b <= x))) AS word FROM m)"""


def _power() -> str:
    keys = " UNION ALL ".join(f"SELECT {i} AS turn, series_id, label, pos, [{', '.join(f'word[{k + 1}]' for k in m)}] AS key FROM wd" for i, m in enumerate(MASKS))
    return f"""{_words()}, keys AS ({keys}),
col AS (SELECT turn, key, label AS cls, count(DISTINCT series_id) AS n FROM keys GROUP BY 1, 2, 3),
sc AS (SELECT keys.series_id, keys.pos, col.cls, sum(col.n) AS score FROM keys JOIN col ON keys.turn = col.turn AND keys.key = col.key GROUP BY 1, 2, 3),
cls AS (SELECT label AS cls, count(*) AS nc FROM s GROUP BY 1),
df AS (SELECT a.series_id, a.pos, 2 * coalesce(sc.score, 0) - nc * {len(MASKS)} AS d FROM wd a CROSS JOIN cls LEFT JOIN sc ON sc.series_id = a.series_id AND sc.pos = a.pos AND sc.cls = cls.cls),
pw AS (SELECT series_id, pos, CAST(sum(abs(d)) - abs(max(d)) - abs(min(d)) + abs(max(d) - min(d)) AS BIGINT) AS power FROM df GROUP BY 1, 2)"""


_EV = """ds AS (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, sum(value) AS x FROM events GROUP BY ALL),
es AS (SELECT u.user_id AS series_id, CAST(u.user_id % 2 AS INTEGER) AS label, CAST(g AS INTEGER) AS day, coalesce(ds.x, 0e0) AS x FROM (SELECT DISTINCT user_id FROM ds WHERE day BETWEEN 0 AND 29) u CROSS JOIN (SELECT unnest(range(30)) AS g) LEFT JOIN ds ON ds.user_id = u.user_id AND ds.day = g)"""

_PROFILE = f"""{_EV}, v AS (SELECT series_id, list(x ORDER BY day) AS v FROM es GROUP BY 1),
w AS (SELECT series_id, CAST(p AS INTEGER) AS p, v[p+1:p+8] AS w FROM v, (SELECT unnest(range(23)) AS p)),
z AS (SELECT series_id, p, w, list_avg(w) AS m, list_stddev_pop(w) AS sd FROM w),
pr AS (SELECT a.series_id AS seq_id, a.p AS pos, b.p AS q, round(sqrt(greatest(2 * (8 - (list_dot_product(a.w, b.w) - 8 * a.m * b.m) / (greatest(a.sd, 1e-7) * b.sd)), 0)), 6) AS d
  FROM z a JOIN z b ON a.series_id = b.series_id AND NOT (b.p - a.p >= -4 AND b.p - a.p < 4) AND b.sd >= 1e-7),
pf AS (SELECT z.series_id AS seq_id, z.p AS pos, b.d AS profile, CAST(b.q AS INTEGER) AS nearest FROM z LEFT JOIN (SELECT seq_id, pos, min({{'d': d, 'q': q}}).d AS d, min({{'d': d, 'q': q}}).q AS q FROM pr GROUP BY 1, 2) b ON b.seq_id = z.series_id AND b.pos = z.p)"""

#: All windows of 8 days with all series.
_ALL = f"""WITH {_EV}, v AS (SELECT series_id, label, list(x ORDER BY day) AS v FROM es GROUP BY 1, 2), w AS MATERIALIZED (SELECT series_id, label, CAST(p AS INTEGER) AS p, v[p+1:p+8] AS w FROM v, (SELECT unnest(range(23)) AS p)),
z AS MATERIALIZED (SELECT series_id, label, p, {_z("w")} AS z FROM w),
d AS (SELECT a.series_id * 1000000 + 8000 + a.p AS cand, b.series_id, b.label, min(list_distance(a.z, b.z)) / sqrt(8) AS r FROM z a, z b GROUP BY 1, 2, 3),
dm AS MATERIALIZED (SELECT cand, round(r, 5) AS dist, label FROM d), {_GAIN}
SELECT cand AS cand_id, z.series_id, z.p AS start_idx, 8 AS length, gain AS score, gap, tau FROM best JOIN z ON z.series_id * 1000000 + 8000 + z.p = cand ORDER BY gain DESC, gap DESC, z.series_id, z.p LIMIT 10"""

#: All windows of 8 and 9 days of running sums with all series, by raw distances.
_PRUNED = f"""WITH {_EV}, cs AS (SELECT series_id, day, sum(x) OVER (PARTITION BY series_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS x FROM es),
tot AS (SELECT series_id, max(CASE WHEN day = 29 THEN x END) AS total FROM cs GROUP BY 1),
v AS (SELECT cs.series_id, CAST(any_value(total) > (SELECT avg(total) FROM tot) AS INTEGER) AS label, list(x ORDER BY day) AS v FROM cs JOIN tot USING (series_id) GROUP BY 1),
w AS MATERIALIZED (SELECT series_id, label, n, CAST(p AS INTEGER) AS p, v[p+1:p+n] AS w FROM v, (SELECT unnest([8, 9]) AS n), LATERAL (SELECT unnest(range(31 - n)) AS p)),
d AS (SELECT a.series_id * 1000000 + a.n * 1000 + a.p AS cand, b.series_id, b.label, min(list_distance(a.w, b.w)) AS r FROM w a JOIN w b ON a.n = b.n GROUP BY 1, 2, 3),
dm AS MATERIALIZED (SELECT cand, round(r, 5) AS dist, label FROM d), {_GAIN}
SELECT cand AS cand_id, w.series_id, w.p AS start_idx, CAST(w.n AS INTEGER) AS length, gain AS score, gap, tau FROM best JOIN w ON w.series_id * 1000000 + w.n * 1000 + w.p = cand ORDER BY gain DESC, gap DESC, w.series_id, w.n, w.p LIMIT 1"""

#: All pairs of windows of 16 events in order of time.
_LONG = """WITH q AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, value FROM events),
l AS (SELECT pos, list(value) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS w FROM q QUALIFY len(w) = 16),
z AS MATERIALIZED (SELECT pos, list_transform(w, lambda x: (x - list_avg(w)) / greatest(list_stddev_pop(w), 1e-7)) AS z, list_stddev_pop(w) < 1e-7 AS flat FROM l),
d AS (SELECT a.pos, arg_min(b.pos, (round(2 * (16 - list_inner_product(a.z, b.z)), 10), b.pos)) AS nearest, max(list_inner_product(a.z, b.z)) AS p FROM z a JOIN z b ON NOT b.flat AND NOT (b.pos - a.pos >= -8 AND b.pos - a.pos < 8) GROUP BY 1)
SELECT z.pos, round(sqrt(greatest(0, 2 * (16 - p))), 6) AS profile, nearest FROM z LEFT JOIN d USING (pos)"""



def _level(name: str, lines: str) -> str:
    """The best cut of each line of ``lines`` (cand, dist, label), under names of its own."""
    out = f"dm AS MATERIALIZED ({lines}), {_GAIN}"
    for table in ("dm", "pts", "nexts", "cuts", "side", "ent", "whole", "cut", "best"):
        out = re.sub(rf"\b{table}\b(?!\.)|\b{table}(?=\.)", f"{table}_{name}", out)
    return out


#: A tree of two levels on the training half: windows of 8 days as candidates of the node that their series is in.
_TREE = f"""WITH {_EV}, s AS (SELECT series_id, label, list(x ORDER BY day) AS v FROM es GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY series_id * 7919 % 1000, series_id) AS place, count(*) OVER (PARTITION BY label) AS total FROM s),
w AS (SELECT series_id, label, place <= ceil(total * 0.5e0) AS train, CAST(p AS INTEGER) AS p, v[p+1:p+8] AS w FROM ranked, (SELECT unnest(range(23)) AS p)),
z AS MATERIALIZED (SELECT series_id, label, train, p, {_z("w")} AS z FROM w),
d AS MATERIALIZED (SELECT a.series_id * 100 + a.p AS cand, a.series_id AS source, b.series_id, b.label, b.train, round(min(list_distance(a.z, b.z)) / sqrt(8), 5) AS dist FROM z a JOIN z b ON a.train GROUP BY ALL),
{_level("a", "SELECT cand, dist, label FROM d WHERE train")},
root AS MATERIALIZED (SELECT cand, tau FROM best_a ORDER BY gain DESC, gap DESC, cand LIMIT 1),
n1 AS MATERIALIZED (SELECT d.series_id, label, train, CASE WHEN dist <= tau THEN 'L' ELSE 'R' END AS path FROM d JOIN root USING (cand)),
{_level("b", "SELECT d.cand, d.dist, d.label FROM d JOIN n1 a ON a.series_id = d.source JOIN n1 b ON b.series_id = d.series_id AND a.path = b.path WHERE d.train")},
inner1 AS MATERIALIZED (SELECT path, cand, tau FROM best_b JOIN (SELECT DISTINCT cand AS c, source FROM d) ON c = cand JOIN n1 ON n1.series_id = source QUALIFY row_number() OVER (PARTITION BY path ORDER BY gain DESC, gap DESC, cand) = 1),
n2 AS MATERIALIZED (SELECT n1.series_id, n1.label, n1.train, n1.path || coalesce(CASE WHEN d.dist <= i.tau THEN 'L' ELSE 'R' END, '') AS path FROM n1 LEFT JOIN inner1 i ON i.path = n1.path LEFT JOIN d ON d.cand = i.cand AND d.series_id = n1.series_id),
votes AS (SELECT path, label, count(*) AS n FROM n2 WHERE train GROUP BY 1, 2),
leaf AS (SELECT path, label AS prediction FROM votes QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, label) = 1)
SELECT n2.series_id, n2.label, prediction FROM n2 JOIN leaf USING (path)"""

_FAST = _ALL.replace("min(list_distance(a.z, b.z)) / sqrt(8) AS r", "min(CASE WHEN list_max(a.z) = list_min(a.z) OR list_max(b.z) = list_min(b.z) THEN sqrt(2) ELSE list_distance(a.z, b.z) / sqrt(8) END) AS r")

_SPLIT = f"""{_S}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY series_id * 7919 % 1000, series_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM s),
sp AS (SELECT series_id, label, v, CASE WHEN place <= ceil(n * 0.5e0) THEN 'train' ELSE 'test' END AS part, place FROM k)"""
_NN = f"""{_SPLIT}, nn AS (SELECT a.series_id, a.label, arg_min(b.label, {{'d': round(list_distance(a.v, b.v), 9), 'i': b.series_id}}) AS prediction FROM sp a JOIN sp b ON a.part = 'test' AND b.part = 'train' GROUP BY 1, 2)"""
_NEAR = f"""{_S}, nn AS (SELECT a.series_id, a.label, min({{'d': round(list_distance(a.v, b.v), 9), 'i': b.series_id, 'l': b.label}}) AS b FROM s a JOIN s b ON a.series_id <> b.series_id GROUP BY 1, 2)"""
_HALVES = f"{_EV}, h AS (SELECT series_id, sum(CASE WHEN day < 15 THEN x ELSE 0e0 END) AS a, sum(CASE WHEN day >= 15 THEN x ELSE 0e0 END) AS b FROM es GROUP BY 1)"
_CENTER = f"{_S}, {_P}, c AS (SELECT label, t, avg(x) AS c FROM pt GROUP BY 1, 2), cv AS (SELECT label, list(c ORDER BY t) AS c FROM c GROUP BY 1)"

#: Each series' cells of its 30 days, two a day.
_CELLS = f"""{_EV}, ends AS (SELECT day, min(x) AS lo, max(x) AS hi FROM es GROUP BY 1),
bins AS (SELECT series_id, label, day, floor((x - lo) / ((hi - lo) / 2)) AS cell FROM es JOIN ends USING (day) WHERE hi - lo >= 1e-5),
k AS (SELECT series_id, label, list(cell ORDER BY day) AS cell FROM bins GROUP BY 1, 2)"""

#: Shares of the classes in ten bins of every dimension.
_HISTOGRAMS = f"""{_S}, {_P}, e AS (SELECT t, min(x) AS lo, max(x) AS hi FROM pt GROUP BY 1),
c AS (SELECT t, label, least(9, floor((x - lo) / coalesce(nullif((hi - lo) / 10, 0), 1))) AS bin, count(*) AS n FROM pt JOIN e USING (t) GROUP BY 1, 2, 3),
p AS MATERIALIZED (SELECT t, label, bin, n / sum(n) OVER (PARTITION BY t, label) AS p FROM c)"""

#: One window of 36 months with all customers.
_SPREAD = f"""WITH m AS (SELECT o_custkey, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS month, sum(CAST(o_totalprice AS DOUBLE)) AS x FROM orders GROUP BY 1, 2),
u AS (SELECT DISTINCT o_custkey, c_mktsegment FROM m JOIN customer ON c_custkey = o_custkey WHERE month BETWEEN 0 AND 79),
v AS (SELECT u.o_custkey AS series_id, c_mktsegment AS label, list(coalesce(x, 0e0) ORDER BY g) AS v FROM u CROSS JOIN (SELECT unnest(range(80)) AS g) LEFT JOIN m ON m.o_custkey = u.o_custkey AND m.month = g GROUP BY 1, 2),
w AS (SELECT series_id, label, p, v[p+1:p+36] AS w FROM v, (SELECT unnest(range(45)) AS p)),
z AS MATERIALIZED (SELECT series_id, label, p, {_z("w")} AS z FROM w), q AS (SELECT z AS q FROM z WHERE p = 0 ORDER BY series_id LIMIT 1),
dm AS MATERIALIZED (SELECT 0 AS cand, round(min(list_distance(q, z)) / 6, 5) AS dist, label FROM z, q GROUP BY series_id, label), {_GAIN}
SELECT gain, gap, tau FROM best"""

#: All pairs of customers by running sums.
_TURNOVER = """WITH m AS (SELECT o_custkey, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS month, sum(CAST(o_totalprice AS DOUBLE)) AS x FROM orders GROUP BY 1, 2),
u AS (SELECT DISTINCT o_custkey, c_mktsegment FROM m JOIN customer ON c_custkey = o_custkey WHERE month BETWEEN 0 AND 79),
g AS (SELECT u.o_custkey AS series_id, c_mktsegment AS label, g, sum(coalesce(x, 0e0)) OVER (PARTITION BY u.o_custkey ORDER BY g) AS x FROM u CROSS JOIN (SELECT unnest(range(80)) AS g) LEFT JOIN m ON m.o_custkey = u.o_custkey AND m.month = g),
t AS MATERIALIZED (SELECT series_id, label, list(x ORDER BY g) AS v FROM g GROUP BY 1, 2),
nn AS (SELECT a.series_id, a.label, b.series_id AS other_id, b.label AS other_label, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.series_id ORDER BY round(list_distance(a.v, b.v), 9), b.series_id) AS place FROM t a JOIN t b ON a.series_id <> b.series_id QUALIFY place <= 3)"""

_SYMBOLS = ", ".join(f"({i}, {j}, {x!r}::DOUBLE)" for i, row in enumerate(distance_table(4)) for j, x in enumerate(row))

_WEEK = "[0e0, 1e0, 3e0, 2e0, 0e0, 1e0, 5e0]"

ORACLES: dict[str, str] = {
    "mass_profile": f"WITH {_EV}, v AS (SELECT series_id, list(x ORDER BY day) AS v FROM es GROUP BY 1), w AS (SELECT series_id, CAST(p AS INTEGER) AS p, v[p+1:p+7] AS w, {_WEEK} AS q FROM v, (SELECT unnest(range(24)) AS p)) SELECT series_id AS seq_id, p AS pos, round(list_distance({_z('w')}, {_z('q')}), 6) AS dist FROM w",
    "fast_topk": _FAST,
    "series_stats": f"WITH {_S} SELECT series_id, round(list_avg(v), 6) AS mean, round(list_stddev_pop(v), 6) AS std, round(list_min(v), 6) AS least, round(list_max(v), 6) AS most, CAST(len(v) AS INTEGER) AS n FROM s",
    "znorm_points": f"WITH {_S}, z AS (SELECT series_id, {_z('v')} AS z FROM s) SELECT series_id, CAST(unnest(range(64)) AS INTEGER) AS t, round(unnest(z), 6) AS z FROM z",
    "window_moments": f"WITH {_S}, {_cands()} SELECT series_id, p AS pos, round(list_avg(w), 6) AS mean, round(list_stddev_pop(w), 6) AS std FROM w",
    "centroid_distance": f"""WITH {_CENTER}, d AS (SELECT series_id, list_distance(v, c) AS d, (list_dot_product(v, c) / len(v) - list_avg(v) * list_avg(c)) / (list_stddev_pop(v) * list_stddev_pop(c)) AS r FROM s JOIN cv USING (label))
SELECT series_id, round(d / 8, 6) AS norm_ed, round(d, 6) AS ed, round(r, 6) AS rho, round(sqrt(greatest(0, 2 * (1 - r))), 6) AS pearson_dist FROM d""",
    "prefix_sums": f"WITH {_S}, {_P} SELECT series_id, CAST(t AS INTEGER) AS t, round(sum(x) OVER w, 6) AS s_x, round(sum(x * x) OVER w, 6) AS s_x2 FROM pt WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING)",
    "sdist_matrix": f"WITH {_dist()} SELECT cand_id, series_id, round(r, 6) AS dist FROM d",
    "sdist_positions": f"WITH {_dist()} SELECT cand_id, series_id, b.p AS pos FROM d",
    "transform_raw": f"WITH {_dist(False)} SELECT cand_id, series_id, round(r, 6) AS dist FROM d",
    "mean_square_min": f"WITH {_dist(False)} SELECT cand_id, series_id, round(r * r / 16, 6) AS dist FROM d",
    "transform_features": f"WITH {_dist(False)} SELECT series_id, label, list(round(r, 6) ORDER BY cand_id) AS features FROM d GROUP BY 1, 2",
    "order_line_classes": f"WITH {_DM} SELECT cand, label, count(*) AS n, min(dist) AS nearest, max(dist) AS farthest FROM dm GROUP BY 1, 2",
    "ig_scores": f"WITH {_DM}, {_GAIN} SELECT cand, gain, gap, tau FROM best",
    "f_scores": f"WITH {_DM} {_F}",
    "kw_scores": f"WITH {_DM}, {_KW}",
    "mood_scores": f"WITH {_DM}, {_MOOD}",
    "gain_bound": _BOUND,
    "topk_shapelets": f"WITH {_DM}, {_GAIN} SELECT cand AS cand_id, zq.source AS series_id, zq.start_idx, 16 AS length, gain AS score, gap, tau FROM best g JOIN zq ON zq.cand_id = g.cand ORDER BY gain DESC, gap DESC, zq.source, zq.start_idx LIMIT 5",
    "brute_topk": _ALL,
    "pruned_topk": _PRUNED,
    "silhouettes": f"WITH {_S}, d AS (SELECT a.series_id, a.label, b.label AS other, avg(power(list_distance(a.v, b.v), 2)) AS d FROM s a JOIN s b ON a.series_id <> b.series_id GROUP BY 1, 2, 3), g AS (SELECT series_id, label, max(CASE WHEN other = label THEN d END) AS a, min(CASE WHEN other <> label THEN d END) AS b FROM d GROUP BY 1, 2) SELECT series_id, label AS cluster, round(coalesce((b - a) / greatest(a, b), 0e0), 6) AS silhouette FROM g",
    "calinski_harabasz": f"WITH {_CENTER}, g AS (SELECT list(x ORDER BY t) AS g FROM (SELECT t, avg(x) AS x FROM pt GROUP BY 1)), w AS (SELECT sum(power(list_distance(v, c), 2)) AS w FROM s JOIN cv USING (label)), b AS (SELECT sum(n * power(list_distance(c, g), 2)) AS b, count(*) AS k, sum(n) AS n FROM cv JOIN (SELECT label, count(*) AS n FROM s GROUP BY 1) USING (label), g) SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS score FROM b, w",
    "spread_line": _SPREAD,
    "tree_predict": _TREE,
    "event_profile": _LONG,
    "topk_no_overlap": _WALK,
    "profile_two_dims": _TWO,
    "sax_words": f"WITH {_words()} SELECT series_id, pos, array_to_string(word, '') AS word FROM wd",
    "sax_distance": f"WITH {_words()}, tb(a, b, d) AS (VALUES {_SYMBOLS}), u AS (SELECT series_id, pos, unnest(range(8)) AS i, unnest(word) AS s FROM wd) SELECT x.series_id, x.pos, round(2 * sum(d), 6) AS dist FROM u x JOIN u y ON x.series_id = y.series_id AND y.pos = x.pos + 16 AND x.i = y.i JOIN tb ON tb.a = x.s AND tb.b = y.s GROUP BY 1, 2",
    "sax_power": f"WITH {_power()} SELECT series_id, pos, power FROM pw",
    "sax_top_windows": f"WITH {_power()} SELECT series_id, pos, power FROM pw ORDER BY power DESC, series_id, pos LIMIT 100",
    "scatter_ratio": f"WITH {_S}, {_P}, c AS (SELECT label, t, avg(x) AS m, coalesce(var_samp(x), 0) AS s, count(*) AS n FROM pt GROUP BY 1, 2), g AS (SELECT t, avg(x) AS g FROM pt GROUP BY 1) SELECT round(sum(n * (m - g) * (m - g)) / (sum(n * (m - g) * (m - g)) + sum(s)), 6) AS ratio FROM c JOIN g USING (t)",
    "davies_bouldin": f"WITH {_CENTER}, sp AS (SELECT label, avg(list_distance(v, c)) AS s FROM s JOIN cv USING (label) GROUP BY 1), r AS (SELECT a.label, max((x.s + y.s) / list_distance(a.c, b.c)) AS r FROM cv a JOIN cv b ON a.label <> b.label JOIN sp x ON x.label = a.label JOIN sp y ON y.label = b.label GROUP BY 1) SELECT round(avg(r), 6) AS dbi FROM r",
    "bhattacharyya": f"WITH {_CELLS}, c AS (SELECT cell, label, count(*) AS n FROM k GROUP BY 1, 2), z AS (SELECT label, count(*) AS size FROM k GROUP BY 1), p AS (SELECT cell, sum(ln(n / size)) AS l, count(*) AS n FROM c JOIN z USING (label) GROUP BY 1) SELECT round(coalesce(sum(exp(l / (SELECT count(*) FROM z))) FILTER (n = (SELECT count(*) FROM z)), 0e0), 6) AS coefficient FROM p",
    "separability_index": f"WITH {_NEAR} SELECT round(avg(CASE WHEN label = b.l THEN 1e0 ELSE 0e0 END), 6) AS si FROM nn",
    "nearest_neighbour": f"WITH {_NEAR} SELECT series_id, b.i AS other_id, round(b.d, 6) AS dist FROM nn",
    "ball_neighbours": f"{_TURNOVER} SELECT series_id, CAST(place AS INTEGER) AS place, other_id, round(dist, 2) AS dist FROM nn",
    "ball_separability": f"{_TURNOVER} SELECT round(avg(CASE WHEN label = other_label THEN 1e0 ELSE 0e0 END), 6) AS si FROM nn WHERE place = 1",
    "jensen_shannon": f"WITH {_HISTOGRAMS}, g AS (SELECT a.t, a.label AS label_a, b.label AS label_b, n.bin FROM (SELECT DISTINCT t, label FROM p) a JOIN (SELECT DISTINCT t, label FROM p) b ON a.t = b.t AND a.label < b.label JOIN (SELECT DISTINCT t, bin FROM p) n ON n.t = a.t), f AS (SELECT g.t, label_a, label_b, coalesce(x.p, 0e0) AS x, coalesce(y.p, 0e0) AS y FROM g LEFT JOIN p x ON x.t = g.t AND x.bin = g.bin AND x.label = label_a LEFT JOIN p y ON y.t = g.t AND y.bin = g.bin AND y.label = label_b) SELECT CAST(t AS INTEGER) AS dim, label_a, label_b, round(sum(CASE WHEN x > 0 THEN x * ln(2 * x / (x + y)) ELSE 0e0 END + CASE WHEN y > 0 THEN y * ln(2 * y / (x + y)) ELSE 0e0 END) / 2, 6) AS jsd FROM f GROUP BY 1, 2, 3",
    "jensen_shannon_mixture": f"WITH {_HISTOGRAMS}, m AS (SELECT t, bin, sum(p) AS m FROM p GROUP BY 1, 2), k AS (SELECT t, count(DISTINCT label) AS k FROM p GROUP BY 1) SELECT CAST(t AS INTEGER) AS dim, round(0.5e0 * sum(p * ln(p * k / m)), 6) AS jsd FROM p JOIN m USING (t, bin) JOIN k USING (t) GROUP BY 1",
    "jensen_shannon_joint": f"WITH {_CELLS.replace('floor', 'least(1, floor', 1).replace('AS cell', ') AS cell', 1)}, p AS (SELECT cell, label, count(*) / sum(count(*)) OVER (PARTITION BY label) AS p FROM k GROUP BY 1, 2), m AS (SELECT cell, sum(p) AS m FROM p GROUP BY 1) SELECT round(0.5e0 * sum(p * ln(p * (SELECT count(DISTINCT label) FROM p) / m)), 6) AS jsd FROM p JOIN m USING (cell)",
    "transformer": f"WITH {_DM}, {_GAIN}, t AS (SELECT zq.cand_id FROM best g JOIN zq ON zq.cand_id = g.cand ORDER BY gain DESC, gap DESC, zq.source, zq.start_idx LIMIT 3), r AS (SELECT q.cand_id, w.series_id, w.label, min(list_distance(q.q, w.w)) AS r FROM q, w WHERE q.cand_id IN (SELECT cand_id FROM t) GROUP BY ALL) SELECT series_id, label, list(round(r, 6) ORDER BY cand_id) AS features FROM r GROUP BY 1, 2",
    "matrix_profile": f"WITH {_PROFILE} SELECT seq_id, pos, profile, nearest FROM pf",
    "motif": f"WITH {_PROFILE} SELECT seq_id, pos, profile FROM pf WHERE profile IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY profile, pos) = 1",
    "discord": f"WITH {_PROFILE} SELECT seq_id, pos, profile FROM pf WHERE profile IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY profile DESC, pos) = 1",
    "event_series": f"WITH {_EV} SELECT series_id, label, day, round(x, 6) AS x FROM es",
    "event_lengths": "WITH l AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT round(quantile_cont(n, 0.25), 6) AS low, round(quantile_cont(n, 0.75), 6) AS high FROM l",
    "customer_series": "WITH m AS (SELECT o_custkey, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS month, sum(CAST(o_totalprice AS DOUBLE)) AS x FROM orders GROUP BY 1, 2), f AS (SELECT * FROM m WHERE month BETWEEN 0 AND 79), l AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM f)), k AS (SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS label FROM l) SELECT o_custkey AS series_id, label, round(sum(x), 2) AS total, CAST(count(*) FILTER (x > 0) AS INTEGER) AS months FROM f JOIN k ON o_custkey = c_custkey GROUP BY 1, 2",
    "stratified_split": f"WITH {_SPLIT} SELECT series_id, label, part FROM sp",
    "stratified_sample": f"WITH {_SPLIT} SELECT series_id, label FROM sp WHERE place <= 10",
    "accuracy": f"WITH {_NN} SELECT count(*) AS n, round(avg(CASE WHEN label = prediction THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM nn",
    "confusion": f"WITH {_NN} SELECT label, prediction, count(*) AS n FROM nn GROUP BY 1, 2",
    "wilcoxon": f"WITH {_HALVES}, d AS (SELECT round(a - b, 9) AS d FROM h WHERE round(a - b, 9) <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2e0 AS r FROM d) SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0e0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0e0 END) AS w_minus, least(sum(CASE WHEN d > 0 THEN r ELSE 0e0 END), sum(CASE WHEN d < 0 THEN r ELSE 0e0 END)) AS statistic FROM r",
    "paired_t": f"WITH {_HALVES} SELECT count(*) AS n, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t FROM h",
    "run_summary": "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM events GROUP BY 1",
}
