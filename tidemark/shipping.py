"""Make the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def archive(path: str) -> str:
    """Write the package, its code and its data, as an archive that Python imports from."""
    root = os.path.dirname(_PACKAGE)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith((".py", ".txt")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    return path


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, unless their path already holds it."""
    root = os.path.dirname(_PACKAGE)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = archive(os.path.join(tempfile.mkdtemp(prefix="tidemark-ship-"), "tidemark_package.zip"))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
