"""Gives the executors this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the Python path of the session's workers, once for each Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_lodestone_shipped", False):
        home = Path(__file__).parent
        target = Path(tempfile.mkdtemp()) / "lodestone.zip"
        with zipfile.ZipFile(target, "w") as z:
            for path in sorted(home.rglob("*.py")):
                z.write(path, path.relative_to(home.parent))
        context.addPyFile(str(target))
        context._lodestone_shipped = True
    return spark
