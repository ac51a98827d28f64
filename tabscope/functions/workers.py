"""Python functions in tasks: executors get this package from the driver."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make the table part of the package importable in Python workers, once for each application."""
    context = spark.sparkContext
    if _shipped.get("to") != context.applicationId:
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="tabscope-")  # the driver serves the file from here
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = Path(folder) / f"tabscope-{Path(folder).name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped["to"] = context.applicationId
