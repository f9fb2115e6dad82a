"""Shared-folder materialisation for operators that read one intermediate more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidemark.workdir import work_dir


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    Every call takes a fresh path, so a retried job never mixes two attempts.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tidemark-work/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
