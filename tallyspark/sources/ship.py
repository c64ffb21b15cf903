"""Makes this package importable on the executors of a session that was started without it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add a zip of the package through Spark, once an application, unless PYTHONPATH has it."""
    named = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if str(_ROOT) in named or app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="tallyspark-zip-")
    made = shutil.make_archive(f"{folder}/tallyspark", "zip", _ROOT, "tallyspark")
    spark.sparkContext.addPyFile(made)
    _shipped.add(app)
