"""History windows: recent tails, older pages, coverage and hydration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.records import Positioned, within_budget
from tidemark.schema import MAX_WAITERS, Limits, Refusal


def tails(rows: DataFrame, stream: str, position: str, size: Column, limits: Limits) -> DataFrame:
    """The newest rows of every stream within budgets: ``stream, first, watermark, records, bytes, refusal``.

    The row limit is pushed below the shuffle, so of a hot stream each task sends a page at most; the
    running sum sees a page for each stream. A stream whose newest record is over budget is OversizedRecord.
    """
    limits = limits.capped()
    newest = Window.partitionBy(stream).orderBy(F.desc(position))
    top = rows.withColumn("__size", size).withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= limits.records)
    running = newest.rowsBetween(Window.unboundedPreceding, 0)
    marked = top.withColumn("__sum", F.sum("__size").over(running))
    over = ((F.col("__size") > limits.record_bytes) | (F.col("__sum") > limits.total_bytes)).cast("int")
    kept = marked.withColumn("__kept", F.max(over).over(running) == 0)
    out = kept.groupBy(stream).agg(
        F.min(F.when(F.col("__kept"), F.col(position))).cast("bigint").alias("first"),
        F.max(position).cast("bigint").alias("watermark"),
        F.count_if("__kept").alias("records"),
        F.coalesce(F.sum(F.when(F.col("__kept"), F.col("__size"))), F.lit(0)).cast("bigint").alias("bytes"),
    )
    return out.withColumn("refusal", F.when(F.col("records") == 0, "OversizedRecord"))


def older_page(table: Positioned, before: int, floor: int, limits: Limits, size: Column) -> DataFrame:
    """Rows that end just before ``before``, newest first within budgets, returned in order of position."""
    if before <= 1 or before <= floor + 1:
        raise Refusal("InvalidRequest")
    limits = limits.capped()
    rows = table.between(floor, before - 1).orderBy(F.desc("position")).limit(limits.records)
    return within_budget(rows, size, limits, F.desc("position"))


def older_pages(rows: DataFrame, stream: str, position: str, before: Column, size: Column, limits: Limits, floor: int = 0) -> DataFrame:
    """The older page of every stream, before a position of its own; the row limit is pushed below the shuffle."""
    limits = limits.capped()
    order = Window.partitionBy(stream).orderBy(F.desc(position))
    top = rows.filter((F.col(position) < before) & (F.col(position) > floor)).withColumn("__size", size)
    top = top.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= limits.records)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = top.withColumn("__sum", F.sum("__size").over(running))
    over = ((F.col("__size") > limits.record_bytes) | (F.col("__sum") > limits.total_bytes)).cast("int")
    return marked.withColumn("__over", F.max(over).over(running)).filter("__over = 0").drop("__r", "__sum", "__over", "__size")


def overlap_conflicts(older: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of an older page that are saved with another id or payload."""
    s = saved.select(*keys, F.col("record_id").alias("__id"), F.col("payload").alias("__b"))
    return older.join(s, keys).filter("record_id <> __id OR NOT payload <=> __b").drop("__id", "__b")


def missing_prefix(older: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of an older page that are not saved yet: what an install adds."""
    return older.join(saved.select(*keys), keys, "left_anti")


def read_state(deleted: Column, live_head: Column, lower_bound: Column, loaded: Column) -> Column:
    """How a view may show a stream, from its saved progress."""
    return (
        F.when(~loaded, "not_loaded").when(deleted, "deleted").when(live_head == 0, "complete_empty").when(lower_bound == 1, "complete").otherwise("partial")
    )


def next_targets(needs: DataFrame, progress: DataFrame, stream: str) -> DataFrame:
    """By stream: the least position still to hydrate, how many needs wait and how many are met."""
    open_ = F.col("lower_target") < F.col("lower_bound")
    return needs.join(progress.select(stream, "lower_bound"), stream).groupBy(stream).agg(
        F.min(F.when(open_, F.col("lower_target"))).alias("next_target"), F.count_if(open_).alias("waiting"), F.count_if(~open_).alias("resolved")
    )


def progress_after_tail(before: dict | None, generation: int, first: int, watermark: int, oldest: int, ordinary_replica: bool = False) -> dict:
    """Progress once a tail is installed: a newer generation, and no older head."""
    if ordinary_replica and before is None:
        raise Refusal("Conflict", "an ordinary replica exists")
    if before:
        if before["deleted"]:
            raise Refusal("Deleted")
        if generation <= before["generation"] or watermark < before["live_head"]:
            raise Refusal("Stale")
    return {"generation": generation, "live_head": watermark, "lower_bound": first, "oldest_available": oldest, "deleted": False}


def progress_after_older(before: dict, generation: int, first: int, last: int, oldest: int) -> dict:
    """Progress once an older page is installed: the lower bound only falls, the floor only rises."""
    if before["deleted"]:
        raise Refusal("Deleted")
    if generation != before["generation"] or last + 1 < before["lower_bound"]:
        raise Refusal("Stale")
    return before | {"lower_bound": min(before["lower_bound"], first), "oldest_available": max(before["oldest_available"], oldest)}


def progress_after_deletion(before: dict | None) -> dict:
    """A permanent fence: no rows, head 0; the generation stays."""
    return {"generation": before["generation"] if before else 0, "live_head": 0, "lower_bound": 1, "oldest_available": 1, "deleted": True}


class HydrationQueue:
    """Combines view needs before the next bounded fetch."""

    def __init__(self, max_waiters: int = MAX_WAITERS):
        if not 0 < max_waiters <= MAX_WAITERS:
            raise Refusal("InvalidRequest")
        self._limit = max_waiters
        self._needs: list[int] = []

    def request(self, lower_target: int) -> None:
        if lower_target <= 0 or len(self._needs) >= self._limit:
            raise Refusal("InvalidRequest")
        self._needs.append(lower_target)

    def next_target(self, lower_bound: int) -> int | None:
        return min((t for t in self._needs if t < lower_bound), default=None)

    def resolve(self, lower_bound: int) -> int:
        waiting = [t for t in self._needs if t < lower_bound]
        met = len(self._needs) - len(waiting)
        self._needs = waiting
        return met

    @property
    def waiters(self) -> int:
        return len(self._needs)
