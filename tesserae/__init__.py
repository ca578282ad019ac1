"""A Spark engine for chunked N-dimensional arrays and the data around them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let Spark send this package to its executors, once for each context; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_has_tesserae", False):
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # else it has been shipped already
        target = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(package.rglob("*.py")):
                z.write(path, path.relative_to(package.parent))
        sc.addPyFile(str(target))
    sc._has_tesserae = True
