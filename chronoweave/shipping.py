"""Makes this package importable in Python workers, wherever the driver found it."""

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
    """Send the package's sources to the executors through Spark, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp())  # the driver's own: executors get the file from Spark
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(top.rglob("*.py")):
            z.write(source, str(source.relative_to(top.parent)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
