"""Sends this package to the executors' Python where it isn't installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a Spark context, as --py-files would; the archive is made on the driver and fetched from it."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    if getattr(context, "_auditloom_sent", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._auditloom_sent = True
