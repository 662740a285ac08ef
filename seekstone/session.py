"""Making the package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_seekstone_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="spark-seekstone-")) / "seekstone.zip"
    with zipfile.ZipFile(to, "w") as z:
        for path in sorted(ROOT.rglob("*.py")):
            z.write(path, path.relative_to(ROOT.parent))
    context.addPyFile(str(to))
    context._seekstone_shipped = True
