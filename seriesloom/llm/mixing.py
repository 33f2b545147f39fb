"""Mixing sources to target weights by entropy balancing.

Of all document rates between 0 and ``cap`` that meet the word target of every source, those of
largest entropy are exponential tilts ``min(cap, exp(lambda_source * words / mean))``.  The convex
dual has one variable per source.  Newton's steps, and points spread over a bracket that keeps them safe, are tried on the
histogram of document sizes, which holds all that the dual needs.  Rates are then rounded into copies.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HELD, ROW_ID, count_words, one_per_id, store, with_ids

#: Rows that are rounded together.
ROUND_ROWS = 1_000
#: Tilts of a source that one job tries, evenly spread over its bracket, besides Newton's steps from both ends.
POINTS = 14


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size and target from (source, source_size): one row per source, null allowed.

    Sources weigh ``cycle``, repeating, in the order of their code points, null last.  They share the
    sum of all sizes by weight; a target stops at ``cap`` times its source, and the excess goes to the
    others by weight: target = min(cap * size, level * weight) with one level for all.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1).cast("int"))
    full = F.lit(float(cap)) * F.col("source_size")
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", weight).withColumn("full", full).withColumn("ratio", F.col("full") / F.col("weight"))
    rows = rows.withColumn("filled", F.sum("full").over(by_ratio) - F.col("full")).withColumn(
        "rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - F.col("filled")) / F.col("rest"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything)["level"]
    return rows.select("source", "source_size", F.least("full", F.coalesce(level, F.lit(0.0)) * F.col("weight")).cast("double").alias("target"))


def tilts(histogram: DataFrame, targets: DataFrame, cap: float = 3.0, tolerance: float = 1e-9) -> DataFrame:
    """targets with ``lambda``, ``mean`` and ``full`` (rates are all ``cap``) from histogram(source, size, documents).

    Every round narrows the bracket, so the rounds end: at the tolerance, or at a bracket that doubles can't narrow.
    The driver holds the brackets of few sources and tries many tilts in a job; those of more are a table, and a job takes one step of each.
    """
    log_cap = F.log(F.lit(float(cap)))
    shape = histogram.where("size > 0").groupBy("source").agg(F.min("size").alias("least"), (F.sum(F.col("size") * F.col("documents")) / F.sum("documents")).alias("mean"))
    state = targets.alias("t").join(shape.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")), "left").select("t.*", "s.least", "s.mean")
    state = state.withColumn("full", F.col("target") >= F.lit(cap * (1 - 1e-12)) * F.col("source_size"))
    state = state.select(
        "*",
        F.lit(0.0).alias("lambda"),
        (-F.log(F.greatest(F.col("source_size") / F.col("target"), F.lit(1.0))) * F.col("mean") / F.col("least") - 1e-6).alias("low"),
        (log_cap * F.col("mean") / F.col("least") + 1e-6).alias("high"),
        (F.col("full") | F.col("mean").isNull() | (F.col("target") <= 0)).alias("done"),
    )
    state = store(state, "mix-dual")
    return _tilts_held(histogram, state, cap, tolerance) if targets.limit(HELD + 1).count() <= HELD else _tilts_joined(histogram, state, cap, tolerance)


def _words(rows: DataFrame, cap: float, *by: str) -> DataFrame:
    """words, and slope by lambda, that rows(size, documents, lambda, mean) take at their tilts."""
    log_cap = F.log(F.lit(float(cap)))
    return rows.withColumn("tilt", F.col("lambda") * F.col("size") / F.col("mean")).groupBy(*by).agg(
        F.sum(F.col("documents") * F.col("size") * F.when(F.col("tilt") >= log_cap, F.lit(float(cap))).otherwise(F.exp("tilt"))).alias("words"),
        F.sum(F.when(F.col("tilt") < log_cap, F.col("documents") * F.col("size") * F.col("size") / F.col("mean") * F.exp("tilt")).otherwise(F.lit(0.0))).alias("slope"),
    )


def _tilts_held(histogram: DataFrame, state: DataFrame, cap: float, tolerance: float) -> DataFrame:
    """state with the tilts that meet the targets, for few sources: one job a round, without stored tables."""
    spark, schema = state.sparkSession, state.schema
    held = [r.asDict() for r in state.collect()]
    known = {x["source"]: x for x in held}
    tries = {k: {0.0} for k, x in known.items() if not x["done"]}
    best = dict.fromkeys(tries, math.inf)
    while tries:
        for source, points in tries.items():
            low, high = known[source]["low"], known[source]["high"]
            points |= {low + (high - low) * i / (POINTS + 1) for i in range(1, POINTS + 1)}
        points = [(source, known[source]["mean"], x) for source, found in tries.items() for x in sorted(found)]
        dealt = F.broadcast(spark.createDataFrame(points, f"s {schema['source'].dataType.simpleString()}, mean double, lambda double"))
        tried = histogram.where("size > 0").join(dealt, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "documents", "mean", "lambda")
        steps: dict[str | None, set[float]] = {source: set() for source in tries}
        for r in sorted(_words(tried, cap, "source", "lambda").collect(), key=lambda r: r["lambda"]):
            one, gap = known[r.source], r.words - known[r.source]["target"]
            if abs(gap) < best[r.source]:
                best[r.source], one["lambda"] = abs(gap), r["lambda"]
            if gap < 0:
                one["low"] = max(one["low"], r["lambda"])
            else:
                one["high"] = min(one["high"], r["lambda"])
            if r.slope > 0:
                steps[r.source].add(r["lambda"] - gap / r.slope)
        for source in steps:
            one = known[source]
            low, high = one["low"], one["high"]
            one["done"] = best[source] <= tolerance * one["target"] or high - low <= 1e-14 * max(1.0, abs(low), abs(high))
        tries = {source: set(sorted((x for x in found if known[source]["low"] < x < known[source]["high"]), key=lambda x, k=source: abs(x - known[k]["lambda"]))[:2]) for source, found in steps.items() if not known[source]["done"]}
    return spark.createDataFrame([tuple(x[c] for c in schema.names) for x in held], schema)


def _tilts_joined(histogram: DataFrame, state: DataFrame, cap: float, tolerance: float) -> DataFrame:
    """What _tilts_held returns, for any number of sources.  Every fourth step halves the bracket."""
    turn = 0
    while state.where("not done").limit(1).count():
        turn += 1
        open_state = state.where("not done").select("source", "lambda", "mean")
        opened = histogram.where("size > 0").alias("h").join(open_state.alias("o"), F.col("h.source").eqNullSafe(F.col("o.source")))
        sums = _words(opened.select("h.source", "size", "documents", "lambda", "mean"), cap, "source")
        gap = F.col("words") - F.col("target")
        low, high = F.when(gap < 0, F.col("lambda")).otherwise(F.col("low")), F.when(gap > 0, F.col("lambda")).otherwise(F.col("high"))
        newton = F.col("lambda") - F.try_divide(gap, F.col("slope"))
        moved = (
            state.alias("a").join(sums.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", "b.words", "b.slope")
            .withColumn("new_low", F.coalesce(low, F.col("low"))).withColumn("new_high", F.coalesce(high, F.col("high")))
            .withColumn("new_done", F.col("done") | F.col("words").isNull() | (F.abs(gap) <= F.lit(tolerance) * F.col("target")) | (F.col("new_high") - F.col("new_low") <= 1e-14 * F.greatest(F.lit(1.0), F.abs("new_low"), F.abs("new_high"))))
            .withColumn("step", F.when((newton > F.col("new_low")) & (newton < F.col("new_high")) & F.lit(turn % 4 > 0), newton).otherwise((F.col("new_low") + F.col("new_high")) / 2))
        )
        state = store(
            moved.select(
                "source", "source_size", "target", "least", "mean", "full",
                F.when(F.col("new_done"), F.col("lambda")).otherwise(F.col("step")).alias("lambda"),
                F.col("new_low").alias("low"), F.col("new_high").alias("high"), F.col("new_done").alias("done"),
            ),
            "mix-dual",
        )
    return state


def mix_documents(docs: DataFrame, cap: int = 3, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken (copies * size) of every document.

    size: words of the text, null none; documents without words have rate 1 and take nothing.  Copies
    are the floor or the ceiling of the rate.  They are chosen in buckets of about ROUND_ROWS documents of
    one source, larger documents first, each document taking up what those before it left over; so the
    words taken in a bucket differ from the wanted ones by about its smallest document.  Buckets are dealt by a hash of doc_id and text, so
    rows without a doc_id spread too; only rows equal in both share one.  The order has no randomness beyond hashes: reruns agree.  Empty input: empty output.
    """
    base = store(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "mix-sizes")
    histogram = store(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("documents")), "mix-histogram")
    per_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size"), F.sum("documents").alias("rows"))
    targets = store(source_targets(per_source.select("source", "source_size"), cycle, cap), "mix-targets")
    state = tilts(histogram, targets, cap).alias("s").join(per_source.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select("s.*", "p.rows")
    state = store(state, "mix-tilts")
    rate = (
        F.when(F.col("d.size") == 0, F.lit(1.0))
        .when(F.col("s.target") <= 0, F.lit(0.0))
        .when(F.col("s.full"), F.lit(float(cap)))
        .otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("s.lambda") * F.col("d.size") / F.col("s.mean"), F.lit(50.0)))))
    )
    rated = base.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.doc_id", "d.source", "d.size", "s.source_size", "s.target", rate.alias("rate"),
        F.pmod(F.xxhash64("d.doc_id", "d.text_hash"), F.ceil(F.col("s.rows") / ROUND_ROWS)).alias("bucket"),
    )
    one = F.struct((-F.col("size")).alias("order"), F.xxhash64("doc_id").alias("spread"), "doc_id", "size", "rate")
    buckets = rated.groupBy("source", "bucket").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sort_array(F.collect_list(one)).alias("docs"))
    # One pass over a bucket; the state is what is still to take, and the copies so far.
    def step(acc, d):
        want = d["size"] * d["rate"] + acc["left"]
        copies = F.when(d["size"] == 0, F.lit(1)).otherwise(
            F.least(F.ceil(d["rate"]), F.greatest(F.floor(d["rate"]), F.floor(F.try_divide(want, d["size"]) + 0.5))).cast("int")
        )
        return F.struct((want - copies * d["size"]).alias("left"), F.array_append(acc["copies"], copies).alias("copies"))

    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<int>").alias("copies"))
    rounded = buckets.withColumn("copies", F.aggregate("docs", start, step, lambda acc: acc["copies"]))
    out = rounded.select("source", "source_size", "target", F.explode(F.arrays_zip("docs", "copies")).alias("x"))
    return out.select(
        "x.docs.doc_id", "source", "x.docs.size", "source_size", "target", "x.docs.rate", "x.copies", (F.col("x.copies") * F.col("x.docs.size")).cast("long").alias("taken")
    )


def repeat_documents(docs: DataFrame, cap: int = 3, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs with every row as often as mix_documents takes it; of rows that share a doc_id, the smallest counts.

    Each row without a doc_id is a document of its own.
    """
    own = docs.columns
    docs = one_per_id(with_ids(docs), ROW_ID)
    copies = mix_documents(docs.select(F.col(ROW_ID).alias("doc_id"), "source", "text"), cap, cycle).where("copies > 0")
    copies = store(copies.select(F.col("doc_id").alias("seriesloom_mix_id"), F.col("copies").alias("seriesloom_mix_copies")), "mix-copies").hint("shuffle_hash")
    both = docs.join(copies, F.col(ROW_ID) == F.col("seriesloom_mix_id"))
    return both.select(*[F.col(f"`{c}`") for c in own], F.explode(F.sequence(F.lit(1), F.col("seriesloom_mix_copies"))).alias("seriesloom_mix_turn")).drop("seriesloom_mix_turn")
