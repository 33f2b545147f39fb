"""The registered queries on series: one operator each, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import clustering, evaluation, metrics, profile, sax, separability
from ..operators.balls import ball_neighbours as by_balls
from ..operators.blocks import nearest
from ..operators.clustering import WarpedKMeans
from ..operators.diagonals import long_profile
from ..operators.distance import candidates, features, mean_square, min_distances
from ..operators.estimators import DtwNeighbours, ShapeletTransform, ShapeletTree
from ..operators.extractors import Brute, Fast, Genetic, Learned, MultiGenetic, Sax, Swarm, rank, top, without_overlap
from ..operators.fitness import logistic_losses
from ..operators.kernel_clusters import KernelKMeans
from ..operators.learners import estimate_lengths, fit_predict
from ..operators.pruned import Pruned
from ..operators.sums import distance_profile
from ..sources import series as S
from ..tables import store

LENGTH = 16
#: Word positions that the three masks keep.
MASKS = [[0, 1, 3, 5, 6], [1, 2, 4, 6, 7], [0, 2, 3, 4, 7]]
DIGITS = 6


def _emb(spark: SparkSession, sf: str) -> DataFrame:
    return S.embedding_series(spark, sf)


def _sources(rows: DataFrame) -> DataFrame:
    """The first series of each label: where the fixed shapelets are cut from."""
    return rows.join(rows.groupBy("label").agg(F.min("series_id").alias("series_id")).select("series_id"), "series_id", "left_semi")


def _cands(rows: DataFrame, step: int = LENGTH) -> DataFrame:
    return candidates(_sources(rows), (LENGTH,), step)


def _dist(spark: SparkSession, sf: str, normalize: bool = True) -> DataFrame:
    rows = _emb(spark, sf)
    return min_distances(rows, _cands(rows), normalize)


def _line(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.order_line(_dist(spark, sf))


def _r(c: str):
    return F.round(c, DIGITS).alias(c)


def series_stats(spark, sf):
    v = F.col("v")
    return _emb(spark, sf).select("series_id", F.round(A.mean(v), DIGITS).alias("mean"), F.round(A.std_pop(v), DIGITS).alias("std"), F.round(F.array_min(v), DIGITS).alias("least"), F.round(F.array_max(v), DIGITS).alias("most"), F.size(v).alias("n"))


def znorm_points(spark, sf):
    rows = _emb(spark, sf).select("series_id", F.posexplode_outer(A.z_norm(F.col("v"))).alias("t", "z"))
    return rows.select("series_id", "t", _r("z"))


def window_moments(spark, sf):
    rows = _emb(spark, sf).select("series_id", F.posexplode_outer(A.windows(F.col("v"), LENGTH)).alias("pos", "w"))
    return rows.select("series_id", "pos", F.round(A.mean(F.col("w")), DIGITS).alias("mean"), F.round(A.std_pop(F.col("w")), DIGITS).alias("std"))


def centroid_distance(spark, sf):
    rows = _emb(spark, sf)
    both = rows.join(F.broadcast(separability.centroids(rows)), "label")
    x, y = F.col("v"), F.col("center")
    return both.select("series_id", F.round(A.norm_euclidean(x, y), DIGITS).alias("norm_ed"), F.round(A.euclidean(x, y), DIGITS).alias("ed"), F.round(A.pearson(x, y), DIGITS).alias("rho"), F.round(A.pearson_distance(x, y), DIGITS).alias("pearson_dist"))


def prefix_sums(spark, sf):
    rows = _emb(spark, sf).select("series_id", F.posexplode("v").alias("t", "x"))
    upto = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("series_id", "t", F.round(F.sum("x").over(upto), DIGITS).alias("s_x"), F.round(F.sum(F.col("x") * F.col("x")).over(upto), DIGITS).alias("s_x2"))


def sdist_matrix(spark, sf):
    return _dist(spark, sf).select("cand_id", "series_id", _r("dist"))


def sdist_positions(spark, sf):
    return _dist(spark, sf).select("cand_id", "series_id", "pos")


def transform_raw(spark, sf):
    return _dist(spark, sf, False).select("cand_id", "series_id", _r("dist"))


def mean_square_min(spark, sf):
    rows = _emb(spark, sf)
    return mean_square(rows, _cands(rows)).select("cand_id", "series_id", _r("dist"))


def order_line_classes(spark, sf):
    return metrics.class_distances(_line(spark, sf)).select("cand", "label", "n", F.element_at("distances", 1).alias("nearest"), F.element_at("distances", -1).alias("farthest"))


def ig_scores(spark, sf):
    return metrics.score(_line(spark, sf), "ig")


def spread_line(spark, sf):
    """The best cut of the line of one window, the first three years of the first customer, with all customers: one line, in many tasks."""
    rows = S.customer_series(spark, sf)
    first = rows.agg(F.min_by("v", "series_id").alias("v")).select(F.lit(0).cast("long").alias("cand_id"), F.slice("v", 1, 36).alias("values"))
    return metrics.spread_gains(metrics.order_line(min_distances(rows, first))).select("gain", "gap", "tau")


def f_scores(spark, sf):
    return metrics.score(_line(spark, sf), "f")


def kw_scores(spark, sf):
    return metrics.score(_line(spark, sf), "kw")


def mood_scores(spark, sf):
    return metrics.score(_line(spark, sf), "mm")


def gain_bound(spark, sf):
    return metrics.gain_bound(_line(spark, sf), 0.05)


def topk_shapelets(spark, sf):
    rows = _emb(spark, sf)
    return top(rank(_cands(rows), rows), 5).select("cand_id", "series_id", "start_idx", "length", "score", "gap", "tau")


def brute_topk(spark, sf):
    """All windows of a length of all series, each with all series."""
    return Brute(8, 9).extract(S.event_series(spark, sf), 10).select("cand_id", "series_id", "start_idx", "length", "score", "gap", "tau")


def pruned_topk(spark, sf):
    """The window of 8 or 9 days of running sums that tells heavy users from light ones best, by raw distances; the entropy bound leaves most windows out."""
    return Pruned(8, 10, normalize=False).extract(S.cumulated(S.event_series(spark, sf)), 1).select("cand_id", "series_id", "start_idx", "length", "score", "gap", "tau")


def fast_topk(spark, sf):
    """The same windows as brute_topk by running sums; a flat window has correlation 0 (brute_topk: zeros)."""
    return Fast(8, 9).extract(S.event_series(spark, sf), 10).select("cand_id", "series_id", "start_idx", "length", "score", "gap", "tau")


def topk_no_overlap(spark, sf):
    rows = _emb(spark, sf)
    return without_overlap(rank(_cands(rows, 4), rows), 10).select("cand_id", "series_id", "start_idx", "length", "score", "gap", "tau")


def _words(spark, sf):
    return sax.words(_emb(spark, sf), 32, 8, 4)


def sax_words(spark, sf):
    return _words(spark, sf).select("series_id", "pos", F.array_join(F.transform("word", lambda x: x.cast("string")), "").alias("word"))


def sax_distance(spark, sf):
    rows = _words(spark, sf)
    nxt = rows.select("series_id", (F.col("pos") - 16).alias("pos"), F.col("word").alias("later"))
    both = rows.join(nxt, ["series_id", "pos"])
    return both.select("series_id", "pos", F.round(sax.word_distance(F.col("word"), F.col("later"), 32, 8, 4), DIGITS).alias("dist"))


def sax_power(spark, sf):
    rows = _emb(spark, sf)
    return sax.power(rows, sax.words(rows, 32, 8, 4), MASKS)


def sax_top_windows(spark, sf):
    return sax.top_windows(sax_power(spark, sf), 100)


def sax_extract(spark, sf):
    return Sax(lengths=(32,), per_length=25).extract(_emb(spark, sf), 5)


def scatter_ratio(spark, sf):
    return separability.scatter_ratio(_emb(spark, sf))


def davies_bouldin(spark, sf):
    return separability.davies_bouldin(_emb(spark, sf))


def bhattacharyya(spark, sf):
    return separability.bhattacharyya(S.event_series(spark, sf), cells=2)


def separability_index(spark, sf):
    return separability.separability_index(_emb(spark, sf))


def nearest_neighbour(spark, sf):
    return separability.nearest_neighbours(_emb(spark, sf)).select("series_id", "other_id", _r("dist"))


def _turnover(spark, sf):
    """Running sums of every customer's monthly orders, labelled by market segment."""
    rows = S.customer_series(spark, sf)
    return S.cumulated(rows).drop("label").join(rows.select("series_id", "label"), "series_id")


def ball_neighbours(spark, sf):
    """The three nearest customers of every customer by turnover; balls leave most pairs out."""
    return by_balls(_turnover(spark, sf), k=3).select("series_id", "place", "other_id", F.round("dist", 2).alias("dist"))


def ball_separability(spark, sf):
    """The share of customers whose nearest customer by turnover is of their market segment."""
    near = by_balls(_turnover(spark, sf))
    return near.agg(F.round(F.avg((F.col("label") == F.col("other_label")).cast("double")), 6).alias("si"))


def jensen_shannon(spark, sf):
    return separability.jensen_shannon(_emb(spark, sf))


def jensen_shannon_mixture(spark, sf):
    return separability.jensen_shannon_mixture(_emb(spark, sf))


def jensen_shannon_joint(spark, sf):
    return separability.jensen_shannon_mixture(S.event_series(spark, sf), 2, joint=True).select("jsd")


def set_losses(spark, sf):
    """Held-out log-loss of logistic regressions on 20 pairs of windows, all fitted together."""
    rows = _emb(spark, sf)
    values = [r["values"] for r in _cands(rows).orderBy("cand_id").collect()]
    sets = [values[i : i + 2] for i in range(0, len(values) - 1, 2)]
    losses = logistic_losses(rows, sets)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "set_id int, loss double")


def warped_clusters(spark, sf):
    """All event series in three clusters under warping."""
    rows = S.event_series(spark, sf)
    return WarpedKMeans(3, 3).fit(rows).predict(rows).select("series_id", "cluster", _r("dist"))


def kernel_clusters(spark, sf):
    """All event series in three clusters by the alignment kernel."""
    rows = S.event_series(spark, sf)
    return KernelKMeans(3).fit(rows).predict(rows).select("series_id", "cluster", _r("dist"))


def silhouettes(spark, sf):
    rows = _emb(spark, sf).withColumnRenamed("label", "cluster")
    return clustering.silhouettes(rows).select("series_id", "cluster", _r("silhouette"))


def calinski_harabasz(spark, sf):
    return clustering.calinski_harabasz(_emb(spark, sf).withColumnRenamed("label", "cluster"))


def _profile(spark, sf):
    rows = S.event_series(spark, sf)
    return profile.matrix_profile(rows.select(F.col("series_id").alias("seq_id"), F.array("v").alias("v")), 8, digits=DIGITS)


def matrix_profile(spark, sf):
    return _profile(spark, sf).select("seq_id", "pos", _r("profile"), "nearest")


def motif(spark, sf):
    return profile.motifs(_profile(spark, sf)).select("seq_id", "pos", _r("profile"))


def discord(spark, sf):
    return profile.motifs(_profile(spark, sf), largest=True).select("seq_id", "pos", _r("profile"))


def profile_two_dims(spark, sf):
    rows = _emb(spark, sf).select(F.col("series_id").alias("seq_id"), F.array(F.slice("v", 1, 32), F.slice("v", 33, 32)).alias("v"))
    return profile.matrix_profile(rows, 8).select("seq_id", "k", "pos", _r("profile"), "nearest")


def event_profile(spark, sf):
    """The matrix profile of all events as one sequence."""
    return long_profile(S.event_sequence(spark, sf), 16).select("pos", _r("profile"), "nearest")


def mass_profile(spark, sf):
    """A week's shape against all windows of all event series."""
    rows = S.event_series(spark, sf).select(F.col("series_id").alias("seq_id"), "v")
    return distance_profile(rows, [0.0, 1.0, 3.0, 2.0, 0.0, 1.0, 5.0]).select("seq_id", "pos", _r("dist"))


def bootstrap_sample(spark, sf):
    return S.bootstrap(_emb(spark, sf)).groupBy("series_id").agg(F.count(F.lit(1)).alias("times"))


def learned_sizes_extract(spark, sf):
    return Learned(sizes={8: 2, 16: 2}, steps=5).extract(_emb(spark, sf), 3)


def event_series(spark, sf):
    rows = S.event_series(spark, sf).select("series_id", "label", F.posexplode("v").alias("day", "x"))
    return rows.select("series_id", "label", "day", _r("x"))


def event_lengths(spark, sf):
    lengths = S.event_points(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("length"))
    return evaluation.length_percentiles(lengths)


def customer_series(spark, sf):
    rows = S.customer_series(spark, sf)
    return rows.select("series_id", F.col("label").cast("int").alias("label"), F.round(A.total(F.col("v")), 2).alias("total"), F.size(F.filter("v", lambda x: x > 0)).alias("months"))


def stratified_split(spark, sf):
    return S.split(_emb(spark, sf), 0.5, F.col("series_id") * 7919 % 1000).select("series_id", "label", "part")


def stratified_sample(spark, sf):
    return S.stratified(_emb(spark, sf), 10, F.col("series_id") * 7919 % 1000).select("series_id", "label")


def _predicted(spark, sf):
    rows = S.split(_emb(spark, sf), 0.5, F.col("series_id") * 7919 % 1000)
    test, train = (rows.where(F.col("part") == p).select("series_id", "label", "v") for p in ("test", "train"))
    return nearest(test, train, 1, same=False).select("series_id", "label", F.col("other_label").alias("prediction"))


def accuracy(spark, sf):
    return evaluation.accuracy(_predicted(spark, sf))


def confusion(spark, sf):
    return evaluation.confusion(_predicted(spark, sf))


def wilcoxon(spark, sf):
    rows = S.event_series(spark, sf)
    return evaluation.wilcoxon(rows.select(A.total(F.slice("v", 1, 15)).alias("a"), A.total(F.slice("v", 16, 15)).alias("b")), "a", "b")


def paired_t(spark, sf):
    rows = S.event_series(spark, sf)
    return evaluation.paired_t(rows.select(A.total(F.slice("v", 1, 15)).alias("a"), A.total(F.slice("v", 16, 15)).alias("b")), "a", "b")


def run_summary(spark, sf):
    return evaluation.summary(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "value")


def tree_predict(spark, sf):
    """A tree of two levels that is grown on all windows of 8 days of the training half of all event series; it predicts every series."""
    rows = S.split(S.event_series(spark, sf), 0.5, F.col("series_id") * 7919 % 1000)
    train = rows.where("part = 'train'").select("series_id", "label", "v")
    return ShapeletTree(Brute(8, 9), max_depth=2).fit(train).predict(rows).select("series_id", "label", "prediction")


def transformer(spark, sf):
    rows = _emb(spark, sf)

    class Fixed:
        def extract(self, series, k):
            return top(rank(_cands(series), series), k)

    out = ShapeletTransform(Fixed(), 3).fit(rows).transform(rows)
    return out.select("series_id", "label", F.transform("features", lambda x: F.round(x, DIGITS)).alias("features"))


def dtw_neighbours(spark, sf):
    rows = S.split(S.event_series(spark, sf), 0.5, F.col("series_id") * 7919 % 1000)
    test, train = (rows.where(F.col("part") == p).select("series_id", "label", "v") for p in ("test", "train"))
    return DtwNeighbours(3).fit(train).predict(test)


def transform_features(spark, sf):
    return features(_dist(spark, sf, False)).select("series_id", "label", F.transform("features", lambda x: F.round(x, DIGITS)).alias("features"))


def _learner(spark, sf, kind):
    """Predictions of the test half by a classifier on distances to windows of the training half: one window of each label, every 16th start."""
    rows = S.split(_emb(spark, sf), 0.5, F.col("series_id") * 7919 % 1000)
    train = rows.where("part = 'train'").select("series_id", "label", "v")
    found = features(min_distances(rows.select("series_id", "label", "v"), _cands(train), False)).join(rows.select("series_id", "part"), "series_id")
    # The fits go over it again and again.
    found = store(found, "learner-features")
    train, test = (found.where(F.col("part") == p).select("series_id", "label", "features") for p in ("train", "test"))
    return fit_predict(kind, train, test, folds=2)


def fit_lr(spark, sf):
    return _learner(spark, sf, "lr")


def fit_rf(spark, sf):
    return _learner(spark, sf, "rf")


def fit_svm(spark, sf):
    return _learner(spark, sf, "svm")


def length_bounds(spark, sf):
    """Bounds of length for a wider search, from shapelets of small samples."""
    low, high = estimate_lengths(S.event_series(spark, sf), Brute(4, 12), rounds=2, per_label=6)
    return spark.createDataFrame([(low, high)], "low int, high int")


def genetic_extract(spark, sf):
    return Genetic(population=12, iterations=4, min_len=8, max_len=24).extract(_emb(spark, sf), 3)


def multi_genetic_extract(spark, sf):
    return MultiGenetic(population=4, iterations=2, min_len=8, max_len=24).extract(_emb(spark, sf))


def guided_genetic_extract(spark, sf):
    """Sets of windows of the event series, bred within clusters of like windows."""
    return MultiGenetic(population=10, iterations=3, min_len=4, max_len=12, guided=0.5).extract(S.event_series(spark, sf))


def swarm_extract(spark, sf):
    return Swarm(particles=10, iterations=4, min_len=8, max_len=24).extract(_emb(spark, sf), 3)


def swarm_lengths_extract(spark, sf):
    return Swarm(particles=10, iterations=4, min_len=8, max_len=24, vary_length=True).extract(_emb(spark, sf), 3)


def learned_extract(spark, sf):
    return Learned(length=LENGTH, shapelets=3, steps=5).extract(_emb(spark, sf), 3)


ALL: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    sdist_matrix, series_stats, znorm_points, window_moments, centroid_distance, prefix_sums, sdist_positions, transform_raw, mean_square_min, order_line_classes,
    ig_scores, spread_line, f_scores, kw_scores, mood_scores, gain_bound, topk_shapelets, brute_topk, pruned_topk, fast_topk, mass_profile, bootstrap_sample, learned_sizes_extract, topk_no_overlap, sax_words, sax_distance, sax_power, sax_top_windows, sax_extract,
    scatter_ratio, davies_bouldin, bhattacharyya, separability_index, nearest_neighbour, ball_neighbours, ball_separability, jensen_shannon, jensen_shannon_mixture, jensen_shannon_joint, set_losses, warped_clusters, kernel_clusters, silhouettes, calinski_harabasz, matrix_profile, event_profile, motif, discord, profile_two_dims,
    event_series, event_lengths, customer_series, stratified_split, stratified_sample, accuracy, confusion, wilcoxon, paired_t, run_summary,
    tree_predict, transformer, dtw_neighbours, fit_lr, fit_rf, fit_svm, length_bounds, transform_features, genetic_extract, multi_genetic_extract, guided_genetic_extract, swarm_extract, swarm_lengths_extract, learned_extract,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
