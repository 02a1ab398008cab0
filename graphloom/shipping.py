"""Makes this package importable in Python workers that were not started with it on their path."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per Spark context, unless PYTHONPATH already names its folder."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_graphloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="graphloom-ship-"))
    shutil.copytree(package, folder / "src" / package.name, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    context.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "src"))
    context._graphloom_shipped = True
