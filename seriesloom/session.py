"""What a session needs before tasks can run this package's functions."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per context, so that it need not be installed where they run."""
    context = spark.sparkContext
    if getattr(context, "_seriesloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="spark-seriesloom-"), "seriesloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(path)
    context._seriesloom_shipped = True
