"""Deterministic data to try catalogues with, and counters of what a read has touched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def churn(spark: SparkSession, entries: int, stride: int) -> DataFrame:
    """A mutation log: all entries are created, every ``stride``-th one is changed, and the last of each four hundreds are deleted."""
    created = spark.range(entries).select("id", F.col("id").alias("seq"), F.lit(False).alias("is_del"), F.lit("created"))
    changed = spark.range(0, entries, stride).select("id", (F.col("id") + entries).alias("seq"), F.lit(False).alias("is_del"), F.lit("changed"))
    deleted = spark.range(entries).filter(F.floor(F.col("id") / 100) % 4 == 3)
    deleted = deleted.select("id", (F.col("id") + 2 * entries).alias("seq"), F.lit(True).alias("is_del"), F.lit(None).cast("string"))
    rows = created.union(changed).union(deleted).toDF("id", "seq", "is_del", "payload")
    return rows.select("seq", F.concat(F.lit("entry-"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("entry_id"), "is_del", "payload")


def counted(rows: DataFrame, size: str, read: Callable[[DataFrame], None]) -> dict:
    """Rows and bytes that an action really reads, observed while it runs: no second pass counts them."""
    seen = Observation()
    read(rows.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.max(size).alias("largest")))
    return seen.get
