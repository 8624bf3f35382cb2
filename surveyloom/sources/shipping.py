"""Sends this package to the executors, for sessions whose workers cannot import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each Spark context: a zip of the package's sources is served by the driver, as with --py-files."""
    context = spark.sparkContext
    if getattr(context, "_surveyloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    # the driver serves the file as long as it runs: executors that join later need it too
    path = os.path.join(tempfile.mkdtemp(prefix="surveyloom-"), "surveyloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"surveyloom/{file.relative_to(root)}")
    context.addPyFile(path)
    context._surveyloom_shipped = True
