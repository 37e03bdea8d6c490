"""This package on the executors' Python path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let the executors import this package, once a session.

    The package is zipped and handed to Spark, which serves the file to every
    executor, also to those that start later. Executors that have the package
    installed find the same code.
    """
    context = spark.sparkContext
    if getattr(context, "_gapline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="gapline-code-"), "gapline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"gapline/{p.relative_to(root)}")
    context.addPyFile(path)
    context._gapline_shipped = True
