"""tidewatch: a PySpark-native analytics engine for maritime remote sensing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each SparkContext, for clusters where it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_tidewatch_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tidewatch-")  # the driver's own: Spark serves the file to executors from there
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "tidewatch.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._tidewatch_shipped = True
