"""Bringing this package to the executors' Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once an application. Every operator with Python code calls it, so nothing need
    be installed or put on a path there. The archive lies with the driver only; Spark hands it to the executors."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = Path(tempfile.mkdtemp(prefix="tickloom-"))
    tree = folder / "tree"
    shutil.copytree(_PACKAGE, tree / _PACKAGE.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / "tickloom-package"), "zip", tree))
    shutil.rmtree(tree)
    _shipped.add(app)
