"""Sending this package to the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    # the driver's own copy; Spark serves it to the executors
    folder = tempfile.mkdtemp(prefix="tidespan-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "tidespan.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(here.rglob("*.py")):
            out.write(source, source.relative_to(here.parent))
    context.addPyFile(os.fspath(target))
    _shipped.add(context.applicationId)
