"""Ordered computations that do not put the whole input, or a hot key, in one task.

A stream is cut into buckets of consecutive order numbers. Windows run inside the
buckets; one row for each bucket carries what crosses its edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = 1 << 16


def with_rank(df: DataFrame, order: str, name: str, width: int = BUCKET, only: Column | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """Number all rows from 1 by an integer column without ties, or with ties that the columns ``then`` decide; with ``only``, those rows: others get the number of the last before them.

    Only the bucket counts, a row for each ``width`` numbers, are summed in one task.
    """
    bucket = F.floor(F.col(order) / width).alias("__bucket")
    rows = df.withColumn("__bucket", bucket)
    counted = F.lit(1) if only is None else F.when(only, 1)
    counts = rows.groupBy("__bucket").agg(F.count(counted).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    own = Window.partitionBy("__bucket").orderBy(order, *then)
    inside = F.row_number().over(own) if only is None else F.count(counted).over(own.rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.withColumn("__in", inside).join(offsets, "__bucket")
    return ranked.withColumn(name, (F.col("__offset") + F.col("__in")).cast("bigint")).drop("__bucket", "__in", "__offset")


def last_before(df: DataFrame, key: str, order: str, value: Column, name: str, width: int = BUCKET) -> DataFrame:
    """The last non-null ``value`` of a key before each row, in the order of an integer column.

    Buckets of a key are windowed apart, so a key that holds much of the table is spread.
    """
    rows = df.withColumn("__bucket", F.floor(F.col(order) / width)).withColumn("__value", value)
    own = Window.partitionBy(key, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order)))
    edges = rows.groupBy(key, "__bucket").agg(last.alias("__edge"))
    earlier = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(key, "__bucket", F.last("__edge", ignorenulls=True).over(earlier).alias("__carried"))
    found = rows.withColumn("__own", F.last("__value", ignorenulls=True).over(own)).join(carried, [key, "__bucket"])
    return found.withColumn(name, F.coalesce("__own", "__carried")).drop("__bucket", "__value", "__own", "__carried")
