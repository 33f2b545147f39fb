"""Quality rules: base counts of a text and robust multivariate outliers.

Documents that pass the base rule give a vector of four transformed statistics.  For every group (language
and source; too small ones are pooled) the minimum covariance determinant is estimated: from two starts,
concentration steps keep the documents up to the distance at which a half of
the group is reached and take mean and covariance from them, until the determinant falls no more; the least one counts.  A document whose squared
Mahalanobis distance exceeds the chi-square quantile is rejected.

All steps are aggregations by group.  Quantiles come from counts per group and bin (bins are of fixed width, so
reruns agree), so the shuffles hold sums, and no task holds a group.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HELD, WORD, store

SYMBOLS = "#*$%&|<>"
RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
DIMS = 4
#: Standard deviations that are added (as variances) to every estimate: smaller spreads say nothing about quality.  In a group without any spread
#: each statistic rejects by itself: a mean word length off by a factor of 1.53, over 4.0 symbols, over 4.1 repeated lines or over 48 repeated words for 100 words.
FLOORS = (0.08, 0.3, 0.12, 0.09)
#: Bins of the coordinates for the first estimate, and bins of the distances a factor of e.
BIN, DISTANCE_BINS = 1 / 256, 32
#: Steps end when the logarithm of the root of the determinant falls by no more than SETTLED; the floors bound it from below, so they do end.
SETTLED = 1e-3
HALF = 0.5
#: Groups under LEAST documents (a half with six for each dimension) are pooled by language, and then altogether; in a last pool under
#: FEWEST (a half with six for four dimensions, one more than a covariance needs) there is no estimate, and nothing is rejected.
LEAST, FEWEST = 50, 12
#: Chance that a document of a normal group is rejected.
TAIL = 1e-5


def _chi2_4(x: float) -> float:
    return 1 - math.exp(-x / 2) * (1 + x / 2)


def _chi2_6(x: float) -> float:
    return 1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8)


def _quantile_4(p: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_4(mid) < p else (low, mid)
    return low


CUTOFF = _quantile_4(1 - TAIL)
#: What makes the covariance of the nearest half that of the whole, for normal data.
CONSISTENCY = HALF / _chi2_6(_quantile_4(HALF))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); clashing columns are replaced.

    Null and empty texts have zeros.  Repeated windows are found inside the row: window hashes (64 bits) are
    compared by sorting, only in texts that repeat any.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keep = [c for c in docs.columns if c not in names]
    as_own = [c.alias(f"own_{i}") for i, c in enumerate(own)]
    carried = [F.col(f"own_{i}") for i in range(len(own))]
    blank = F.translate(t, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    one = docs.select(*as_own, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"), F.char_length(blank).alias("chars"), (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).alias("symbols"), lines.alias("lines"))
    counts = [F.col("chars"), F.col("symbols")]
    n = F.size("words")
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    hashes = F.when(n > 3, F.transform(F.sequence(F.lit(0), n - 3), window))
    two = one.select(*carried, n.alias("n"), *counts, (F.size("lines") - F.size(F.array_distinct("lines"))).alias("dups"), hashes.alias("hashes"))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    three = two.select(*carried, "n", *counts, "dups", F.when(repeats, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))).alias("sorted"))
    twice = F.filter("sorted", lambda x, i: (x["h"] == F.get("sorted", i - 1)["h"]) | (x["h"] == F.get("sorted", i + 1)["h"]))
    at = F.sort_array(F.transform(twice, lambda x: x["at"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
    covered = F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")), lambda a: a["sum"])
    return three.select(
        *[F.col(f"own_{i}").alias(c) for i, c in enumerate(keep)],
        *[x.cast("long").alias(name) for x, name in zip((F.col("n"), F.col("chars"), F.col("symbols"), F.col("dups"), F.coalesce(covered, F.lit(0))), names, strict=True)],
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(100 * F.col("n_symbols") / n),
        F.sqrt(10 * F.col("n_dup_lines") / n),
        F.col("n_repeat_words") / n,
    ]


def _pools(rows: DataFrame) -> DataFrame:
    """rows with ``pool``: the group that a row's estimate comes from; null where that is too small."""
    # Nulls are written out: a null source is not a pool of all sources.
    key = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    groups = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < LEAST
    by_lang = F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("lang"))
    groups = groups.withColumn("lang_n", by_lang)
    last = F.sum(F.when(small & (F.col("lang_n") < LEAST), F.col("n")).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    pool = F.when(~small, key("lang", "source")).when(F.col("lang_n") >= LEAST, key("lang")).when(F.col("last_n") >= FEWEST, F.lit("all"))
    groups = store(groups.withColumn("last_n", last).select("lang", "source", pool.alias("pool")), "quality-pools")
    return rows.alias("r").join(groups.alias("g"), F.col("r.lang").eqNullSafe(F.col("g.lang")) & F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.*", "g.pool")


def _cholesky(model: DataFrame) -> DataFrame:
    """pool, start, m0.. and the lower triangle l00, l10, l11.. of the covariance c00, c10, c11.."""
    for i in range(DIMS):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            model = model.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    return model.select("pool", "start", *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)])


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. to the model in the same row, by forward substitution."""
    z: list[Column] = []
    for i in range(DIMS):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _second() -> list[Column]:
    """c00, c10, c11..: covariances of x0.. with the consistency factor and the floors."""
    return [(F.covar_pop(f"x{i}", f"x{j}") * CONSISTENCY + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(DIMS) for j in range(i + 1)]


def _starts(rows: DataFrame) -> DataFrame:
    """pool, start, m0.. and c00.. of the first models: 0 has medians and quartile ranges by coordinate, 1 mean and covariance of all."""
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(f"x{i}") / BIN).alias("bin")) for i in range(DIMS)]))
    bins = rows.select("pool", entry.alias("e")).groupBy("pool", "e.dim", "e.bin").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy("pool", "dim").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("n").over(ordered)).withColumn("all", F.sum("n").over(Window.partitionBy("pool", "dim")))
    quartile = lambda p: F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("bin")))
    quartiles = bins.groupBy("pool", "dim").agg(quartile(0.25).alias("q1"), quartile(0.5).alias("q2"), quartile(0.75).alias("q3"))
    middle = [F.max(F.when(F.col("dim") == i, (F.col("q2") + 0.5) * BIN)).alias(f"m{i}") for i in range(DIMS)]
    spread = [F.max(F.when(F.col("dim") == i, F.pow((F.col("q3") - F.col("q1")) * BIN / 1.349, F.lit(2)) + FLOORS[i] ** 2)).alias(f"c{i}{i}") for i in range(DIMS)]
    robust = quartiles.groupBy("pool").agg(*middle, *spread)
    for i in range(DIMS):
        for j in range(i):
            robust = robust.withColumn(f"c{i}{j}", F.lit(0.0))
    whole = rows.groupBy("pool").agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(DIMS)], *_second())
    return robust.withColumn("start", F.lit(0)).unionByName(whole.withColumn("start", F.lit(1)))


def estimate(rows: DataFrame) -> DataFrame:
    """pool, m0.. and l00..: the estimate of every pool of rows(pool, x0..).

    From each start concentration steps are taken until its determinant falls no more; the start with the least determinant counts.
    The driver holds the models of few pools, and a step is one job; those of more are tables.
    """
    starts = store(_starts(rows), "quality-starts")
    return _estimate_held(rows, starts) if starts.limit(2 * HELD + 1).count() <= 2 * HELD else _estimate_joined(rows, starts)


def _factor(c: dict[str, float]) -> dict[str, float]:
    """The lower triangle l00, l10, l11.. of the covariance c00, c10, c11.."""
    low: dict[str, float] = {}
    for i in range(DIMS):
        for j in range(i + 1):
            rest = c[f"c{i}{j}"] - sum(low[f"l{i}{k}"] * low[f"l{j}{k}"] for k in range(j))
            low[f"l{i}{j}"] = math.sqrt(rest) if i == j else rest / low[f"l{j}{j}"]
    return low


def _estimate_held(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """What _estimate_joined returns: a step sums the moments about the model by ring, and those of the nearest half by pool."""
    spark = rows.sparkSession
    names = [f"m{i}" for i in range(DIMS)] + [f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)]
    model = {}
    for r in starts.collect():
        c = r.asDict()
        model[r.pool, r.start] = {f"m{i}": c[f"m{i}"] for i in range(DIMS)} | _factor(c) | {"log_det": math.inf}
    live = set(model)
    off = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(DIMS)]
    moments = {f"s{i}": off[i] for i in range(DIMS)} | {f"s{i}{j}": off[i] * off[j] for i in range(DIMS) for j in range(i + 1)}
    ordered, whole = Window.partitionBy("pool", "start").orderBy("ring"), Window.partitionBy("pool", "start")
    while live:
        dealt = F.broadcast(spark.createDataFrame([(*key, *[model[key][c] for c in names]) for key in sorted(live)], f"pool string, start int, {', '.join(f'{c} double' for c in names)}"))
        near = rows.join(dealt, "pool").withColumn("ring", F.floor(F.log(distance() + 1e-6) * DISTANCE_BINS))
        rings = near.groupBy("pool", "start", "ring").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in moments.items()])
        before = F.sum("n").over(ordered) - F.col("n")
        half = rings.withColumn("before", before).withColumn("all", F.sum("n").over(whole)).where(F.col("before") < HALF * F.col("all"))
        for r in half.groupBy("pool", "start").agg(*[F.sum(k).alias(k) for k in ("n", *moments)]).collect():
            key, was = (r.pool, r.start), model[r.pool, r.start]
            mean = [r[f"s{i}"] / r.n for i in range(DIMS)]
            c = {f"c{i}{j}": (r[f"s{i}{j}"] / r.n - mean[i] * mean[j]) * CONSISTENCY + (FLOORS[i] ** 2 if i == j else 0.0) for i in range(DIMS) for j in range(i + 1)}
            moved = {f"m{i}": was[f"m{i}"] + mean[i] for i in range(DIMS)} | _factor(c)
            moved["log_det"] = sum(math.log(moved[f"l{i}{i}"]) for i in range(DIMS))
            # A step that doesn't lower the determinant is not taken.
            if moved["log_det"] < was["log_det"] - SETTLED:
                model[key] = moved
            else:
                live.discard(key)
    best = {pool: min((model[pool, s]["log_det"], s) for s in (0, 1))[1] for pool, _ in model}
    return spark.createDataFrame([(pool, *[model[pool, s][c] for c in names]) for pool, s in best.items()], f"pool string, {', '.join(f'{c} double' for c in names)}")


def _estimate_joined(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """What _estimate_held returns, for any number of pools."""
    best = store(_cholesky(starts).withColumn("log_det", F.lit(float("inf"))).withColumn("live", F.lit(True)), "quality-model")
    while best.where("live").limit(1).count():
        near = rows.join(best.where("live"), "pool").withColumn("ring", F.floor(F.log(distance() + 1e-6) * DISTANCE_BINS))
        rings = near.groupBy("pool", "start", "ring").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("pool", "start").orderBy("ring"))
        rings = rings.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy("pool", "start")))
        edge = store(rings.where(F.col("upto") >= HALF * F.col("all")).groupBy("pool", "start").agg(F.min("ring").alias("edge")), "quality-edge")
        half = near.join(edge, ["pool", "start"]).where("ring <= edge")
        moved = _cholesky(half.groupBy("pool", "start").agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(DIMS)], *_second()))
        moved = moved.withColumn("log_det", sum((F.log(f"l{i}{i}") for i in range(1, DIMS)), F.log("l00")))
        before = best.select("pool", "start", F.col("log_det").alias("was"))
        moved = moved.join(before, ["pool", "start"]).withColumn("live", F.col("log_det") < F.col("was") - SETTLED).drop("was")
        # A step that doesn't lower the determinant is not taken.
        taken = moved.where("live")
        stays = best.join(taken.select("pool", "start"), ["pool", "start"], "left_anti").withColumn("live", F.lit(False))
        best = store(taken.unionByName(stays), "quality-model")
    least = best.groupBy("pool").agg(F.min(F.struct("log_det", "start"))["start"].alias("start"))
    return best.join(least, ["pool", "start"]).drop("start", "log_det", "live")


def judge(docs: DataFrame) -> DataFrame:
    """RESULT, lang, source and ``text_hash`` (64-bit hash of the text) of every row of (doc_id, text, lang, source).

    kept is false if base_failed; else if distance (squared Mahalanobis) exceeds CUTOFF.  Null language or source: a
    group like any other.  distance is null for documents that fail the base rule or have no estimate; the latter are kept.
    Long texts count whole; rows that repeat are judged each, and alike within a group.  Empty table: empty result.
    """
    slim = docs.select("doc_id", "lang", "source", "text", F.xxhash64("text").alias("text_hash"))
    rows = with_statistics(slim).drop("text").withColumn("base_failed", base_failed())
    rows = store(rows, "quality-rows")
    vectors = _pools(rows.where("not base_failed")).select("doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lang", "source", "pool", *[v.alias(f"x{i}") for i, v in enumerate(_vector())])
    vectors = store(vectors, "quality-vectors")
    model = estimate(vectors.where("pool IS NOT NULL").select("pool", *[f"x{i}" for i in range(DIMS)]))
    judged = vectors.join(model, "pool", "left").withColumn("distance", distance())
    failed = rows.where("base_failed").withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    judged = judged.withColumn("kept", F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))
    return judged.select(*RESULT, "lang", "source", "text_hash").unionByName(failed.select(*RESULT, "lang", "source", "text_hash"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that ``judge`` keeps, unchanged."""
    names = {"doc_id": "seriesloom_bad_id", "lang": "seriesloom_bad_lang", "source": "seriesloom_bad_source"}
    bad = judge(docs).where("not kept").select(*[F.col(c).alias(x) for c, x in names.items()], F.col("text_hash").alias("seriesloom_bad_hash")).distinct()
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(x)) for c, x in names.items()], F.xxhash64("text") == F.col("seriesloom_bad_hash"))
    return docs.join(store(bad, "quality-bad").hint("shuffle_hash"), on, "left_anti")
