"""Making the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors through Spark's file server, once a Spark application.

    Nothing is sent if all executors run on this machine and PYTHONPATH names the folder of the package.
    """
    root = Path(__file__).resolve().parents[1]
    application = spark.sparkContext.applicationId
    here = spark.sparkContext.master.startswith("local")
    if application in _shipped or here and str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    # The driver serves this file to the executors as long as the application runs, so it stays.
    archive = os.path.join(tempfile.mkdtemp(prefix="vitrail-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
