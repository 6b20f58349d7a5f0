"""Makes this package importable in Python workers that don't have it installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors as a zip file, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="spark-package-")) / root.name
    sc.addPyFile(shutil.make_archive(str(base), "zip", root.parent, root.name))
    _shipped.add(sc.applicationId)
