"""Classifiers of MLlib on distance features, and searches over their and the extractors' parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.series import stratified
from .evaluation import length_percentiles
from .extractors import extractor


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select("series_id", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("x"))


def fit_predict(kind: str, train: DataFrame, test: DataFrame, folds: int = 3, seed: int = 1337) -> DataFrame:
    """(series_id, label, prediction) of test(series_id, label, features); kind: lr, rf or svm, tuned by cross-validation on train."""
    if kind == "lr":
        model = LogisticRegression(featuresCol="x", maxIter=20)
        grid = ParamGridBuilder().addGrid(model.regParam, [0.01, 0.1]).build()
    elif kind == "rf":
        model = RandomForestClassifier(featuresCol="x", seed=seed)
        grid = ParamGridBuilder().addGrid(model.numTrees, [10, 50]).addGrid(model.maxDepth, [3, 8]).build()
    elif kind == "svm":
        inner = LinearSVC(featuresCol="x", maxIter=20)
        model = OneVsRest(classifier=inner, featuresCol="x", parallelism=4)
        grid = ParamGridBuilder().addGrid(inner.regParam, [0.01, 0.1]).build()
    else:
        raise KeyError(kind)
    scorer = MulticlassClassificationEvaluator(metricName="accuracy")
    best = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=scorer, numFolds=folds, seed=seed, parallelism=4).fit(_vectors(train))
    return best.transform(_vectors(test)).select("series_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


def estimate_lengths(series: DataFrame, method: object, rounds: int = 3, per_label: int = 5, k: int = 10, low: float = 0.25, high: float = 0.75) -> tuple[int, int]:
    """Bounds for a wider search: percentiles of the lengths of shapelets found in small stratified samples; they differ by one at least."""
    found = None
    for turn in range(rounds):
        few = stratified(series, per_label, F.xxhash64("series_id", F.lit(turn)))
        lengths = extractor(method).extract(few, k).select("length")
        found = lengths if found is None else found.unionAll(lengths)
    r = length_percentiles(found, low, high).first()
    return int(r.low), max(int(r.low) + 1, int(r.high))


def sweep(points: Iterable[dict], run: Callable[..., float]) -> list[dict]:
    """Each point of a parameter grid with ``accuracy``, what run(**point) gives."""
    return [point | {"accuracy": run(**point)} for point in points]
