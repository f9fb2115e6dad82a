"""The folder that all executors share, for intermediates and durable tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a temporary folder removed at exit;
    a cluster falls back to the warehouse, which is shared as well.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tidemark-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        return "file://" + _LOCAL[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
