"""The transform on a stream of series: it needs no state, so each micro-batch is matched with the same shapelets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.distance import min_distances


def stream_distances(stream: DataFrame, shapelets: DataFrame, normalize: bool = False) -> DataFrame:
    """min_distances of a streaming DataFrame(series_id, label, v) to a table of shapelets."""
    return min_distances(stream, shapelets, normalize)
