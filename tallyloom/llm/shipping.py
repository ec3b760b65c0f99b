"""Making this package importable for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once per application.

    Nothing is sent where workers find them anyway: the folder is on
    PYTHONPATH or is the working folder. The archive is a file of the driver,
    which Spark itself copies to every executor.
    """
    context = spark.sparkContext
    on_path = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if on_path or Path.cwd() == ROOT or context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp()) / "tallyloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((ROOT / "tallyloom").rglob("*.py")):
            out.write(path, path.relative_to(ROOT))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
