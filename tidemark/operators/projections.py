"""Host projections: transcripts, task boards, epoch-fenced rows, coalesced wake hints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import escape_html, field_length, text_field
from tidemark.operators.ordering import BUCKET, last_before


def transcript(rows: DataFrame, stream: str, position: str, text: str) -> DataFrame:
    """Escaped texts with their place; sorted by stream and position with a range-partitioned sort."""
    return rows.select(stream, position, escape_html(F.col(text)).alias("text")).orderBy(stream, position)


def task_operations(records: DataFrame) -> DataFrame:
    """Decode task payloads: a tag byte (17 create, 18 title, 19 complete, 20 delete), then fields."""
    p = F.col("payload")
    tag = F.conv(F.hex(F.substring(p, 1, 1)), 16, 10).cast("int")
    second = (F.lit(3) + field_length(p, 1)).cast("int")
    op = F.element_at(F.create_map(*[F.lit(x) for pair in ((17, "create"), (18, "title"), (19, "complete"), (20, "delete")) for x in pair]), tag)
    done = F.conv(F.hex(F.substring(p, second + 1, F.lit(1))), 16, 10).cast("int")
    return records.select(
        "position", op.alias("op"), text_field(p, 1).alias("task"),
        F.when(tag.isin(17, 18), text_field(p, second)).alias("title"), F.when(tag == 19, done == 1).alias("done"),
    )


def task_board(operations: DataFrame) -> DataFrame:
    """``task``, ``title``, ``done`` of tasks that exist at the end.

    Every field is the last one set since the task's last creation, by aggregations
    alone: creations first, then what follows them.
    """
    lives = operations.groupBy("task").agg(
        F.max(F.when(F.col("op") == "create", F.col("position"))).alias("__born"), F.max(F.when(F.col("op") == "delete", F.col("position"))).alias("__died")
    ).filter("__born IS NOT NULL AND (__died IS NULL OR __died < __born)")
    mine = operations.join(lives.select("task", "__born"), "task").filter("position >= __born")
    return mine.groupBy("task").agg(
        F.max_by("title", F.when(F.col("title").isNotNull(), F.col("position"))).alias("title"),
        F.coalesce(F.max_by("done", F.when(F.col("done").isNotNull(), F.col("position"))), F.lit(False)).alias("done"),
    )


def task_violations(operations: DataFrame) -> DataFrame:
    """Operations whose precondition fails: a second creation, or any other operation on a missing task."""
    turned = F.when(F.col("op").isin("create", "delete"), F.col("op"))
    rows = last_before(operations, "task", "position", turned, "__last")
    exists = F.coalesce(F.col("__last") == "create", F.lit(False))
    wrong = F.when(F.col("op") == "create", exists).otherwise(~exists)
    return rows.withColumn("__wrong", wrong).filter("__wrong").drop("__wrong", "__last")


def epoch_fenced(rows: DataFrame, observed: DataFrame, authority: str = "authority", epoch: str = "epoch") -> DataFrame:
    """Rows stamped with exactly the observed epoch of their authority; writers of older epochs are out."""
    o = observed.groupBy(authority).agg(F.max(epoch).alias("__epoch"))
    return rows.join(o, authority).filter(F.col(epoch) == F.col("__epoch")).drop("__epoch")


def coalesced_hints(arrivals: DataFrame, window: str, head: str = "head", width: int = BUCKET) -> DataFrame:
    """The one head that wakes a receiver for each window (an integer) of arrivals, emitted only if it rises above all before.

    Windows are numbered in buckets; a row for each bucket carries the highest head before it.
    """
    heads = arrivals.groupBy(window).agg(F.max(head).alias("head"), F.count("*").alias("hints"))
    rows = heads.withColumn("__bucket", F.floor(F.col(window) / width))
    tops = rows.groupBy("__bucket").agg(F.max("head").alias("__top"))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__bucket", F.max("__top").over(earlier).alias("__carried"))
    own = Window.partitionBy("__bucket").orderBy(window).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("__own", F.max("head").over(own)).join(tops, "__bucket")
    before = F.greatest("__own", "__carried")
    return found.withColumn("emitted", before.isNull() | (F.col("head") > before)).drop("__bucket", "__own", "__carried")
