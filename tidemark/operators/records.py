"""Ordered immutable records: heads, bounded pages, local reads, catch-up and replay checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.schema import MAX_APPEND_BYTES, Limits, Refusal


@dataclass(frozen=True)
class Positioned:
    """Records whose position is a raw column plus a shift.

    Ranges are filters on the raw column, so they reach the Parquet scan.
    """

    df: DataFrame
    raw: str
    shift: int = 0

    def all(self) -> DataFrame:
        return self.df.withColumn("position", (F.col(self.raw) + self.shift).cast("bigint"))

    def between(self, after: int, target: int) -> DataFrame:
        """Positions in (after, target]."""
        raw = F.col(self.raw)
        kept = self.df.filter((raw > after - self.shift) & (raw <= target - self.shift))
        return kept.withColumn("position", (raw + self.shift).cast("bigint"))

    def head(self) -> DataFrame:
        return self.df.agg((F.coalesce(F.max(self.raw) + self.shift, F.lit(0))).cast("bigint").alias("head"))


def check_range(after: int, target: int, limits: Limits, policy: Limits | None = None) -> None:
    """Refuse an empty range, or budgets beyond the receiver's policy."""
    over = policy and (limits.records > policy.records or limits.total_bytes > policy.total_bytes or limits.record_bytes > policy.record_bytes)
    if target <= after or over:
        raise Refusal("InvalidRange")


def within_budget(rows: DataFrame, size: Column, limits: Limits, *order: Column) -> DataFrame:
    """The longest prefix, in order, in which no record and no running sum is over budget.

    ``rows`` holds a page at most, so its window is bounded.
    """
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("__sum", F.sum(size).over(running))
    over = ((size > limits.record_bytes) | (F.col("__sum") > limits.total_bytes)).cast("int")
    return marked.withColumn("__over", F.max(over).over(running)).filter("__over = 0").drop("__sum", "__over")


def page(table: Positioned, after: int, target: int, limits: Limits, size: Column) -> DataFrame:
    """A forward page: a range scan, the first rows by position, then the budget's prefix."""
    limits = limits.capped()
    check_range(after, target, limits)
    first = table.between(after, target).orderBy("position").limit(limits.records)
    return within_budget(first, size, limits, F.col("position"))


def page_late(table: Positioned, after: int, target: int, limits: Limits, size: str, payload: str) -> DataFrame:
    """The same page in two steps: sizes decide first, then only kept rows read their payload."""
    narrow = Positioned(table.df.drop(payload), table.raw, table.shift)
    kept = page(narrow, after, target, limits, F.col(size)).select("position")
    return table.between(after, target).join(F.broadcast(kept), "position", "left_semi")  # a page of rows at most


def page_refusal(table: Positioned, after: int, target: int, limits: Limits, size: Column, floor: int = 0) -> DataFrame:
    """One row with ``refusal``: Pruned, InvalidRange, OversizedRecord, or null if a page can be read."""
    limits = limits.capped()
    first = table.between(after, target).orderBy("position").limit(1).select("position", size.alias("size"))
    seen = first.agg(F.max("position").alias("position"), F.max("size").alias("size"))
    return seen.join(table.head()).select(
        F.when(F.lit(after < floor), "Pruned")
        .when(F.lit(target) > F.col("head"), "InvalidRange")
        .when(F.col("position").isNull() | (F.col("position") != after + 1), "Pruned")
        .when(F.col("size") > min(limits.record_bytes, limits.total_bytes), "OversizedRecord")
        .alias("refusal")
    )


def page_gap(page: DataFrame, after: int) -> DataFrame:
    """One row with ``refusal``: Pruned if the positions of a page are not dense from ``after`` on. The page is bounded."""
    seen = page.agg(F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.max("position").alias("hi"))
    return seen.select(F.when((F.col("n") > 0) & ((F.col("hi") != F.lit(after) + F.col("n")) | (F.col("d") != F.col("n"))), "Pruned").alias("refusal"))


def density_gaps(table: Positioned, after: int, target: int, width: int = 1 << 16) -> DataFrame:
    """One row: ``expected``, ``found`` and ``distinct`` positions of a range, and its ``gaps``.

    A sum over buckets; no global window.
    """
    rows = table.between(after, target).select("position")
    counts = rows.groupBy(F.floor(F.col("position") / width).alias("bucket")).agg(
        F.count("*").alias("found"), F.count_distinct("position").alias("distinct_positions")
    )
    total = counts.agg(F.coalesce(F.sum("found"), F.lit(0)).alias("found"), F.coalesce(F.sum("distinct_positions"), F.lit(0)).alias("distinct_positions"))
    return total.select(F.lit(target - after).cast("bigint").alias("expected"), "found", "distinct_positions", (F.lit(target - after) - F.col("distinct_positions")).alias("gaps"))


#: Buckets whose maps are composed in one task.
FANOUT = 64


def _next_starts(sizes: np.ndarray, limits: Limits) -> np.ndarray:
    """For each record, the index just after the page that starts there; a record over budget is passed alone."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.searchsorted(total, total[:-1] + limits.total_bytes, "right") - 1
    return np.maximum(np.minimum(ends, np.arange(len(sizes)) + limits.records), np.arange(len(sizes)) + 1)


def greedy_pages(rows: DataFrame, limits: Limits, bucket: int = 1 << 12) -> DataFrame:
    """``page`` (from 1), ``first_position``, ``last_position``, ``records``, ``bytes`` of consecutive greedy pages.

    Rows have dense ``position`` and ``size``. Where a page starts depends on the page before, so
    buckets of positions first map each possible start in their first ``records`` rows to the start it leads to in
    the next bucket. Maps of ``FANOUT`` neighbours are composed into one, level by level; the starts then come down the levels,
    and the pages are laid out in each bucket at once. A bucket also reads the ``records`` rows after it.
    """
    reach = limits.records
    if bucket < reach:
        raise Refusal("InvalidLimits", "a bucket must hold a page")
    own = F.floor((F.col("position") - 1) / bucket)
    spread = rows.select("position", "size", F.explode(F.array_distinct(F.array(own, F.floor((F.col("position") - 1 - reach) / bucket)))).alias("bucket")).filter("bucket >= 0")

    def walk(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, int]:
        table = table.sort_by("position")
        b = table["bucket"][0].as_py()
        position, sizes = table["position"].to_numpy(), table["size"].to_numpy()
        inside = int(np.searchsorted(position, (b + 1) * bucket, "right"))
        return b, position, sizes, _next_starts(sizes, limits), inside

    def exits(table):
        b, position, _, jump, inside = walk(table)
        out = np.arange(len(position) + 1)
        for i in range(inside - 1, -1, -1):
            out[i] = out[jump[i]] if jump[i] < inside else jump[i]
        enter = np.arange(min(reach, inside) + 1)  # just behind the last record, too
        return pa.table({"bucket": np.full(len(enter), b), "enter": enter, "leave": out[enter] - inside})

    def rows_of(table):
        """The maps of neighbouring buckets, each by its first place, in order."""
        table = table.sort_by([("bucket", "ascending"), ("enter", "ascending")])
        buckets, leaves = table["bucket"].to_numpy(), table["leave"].to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(buckets, prepend=-1)), len(buckets))
        return [(int(buckets[a]), leaves[a:z]) for a, z in zip(cuts[:-1], cuts[1:])]

    def compose(table):
        maps = rows_of(table)
        at = np.arange(len(maps[0][1]))
        for _, leave in maps:
            at = leave[at]
        return pa.table({"bucket": np.full(len(at), maps[0][0] // FANOUT), "enter": np.arange(len(at)), "leave": at})

    def descend(keys, table):
        at, out = table["start"][0].as_py(), []
        for bucket, leave in rows_of(table.drop(["start"])):
            out.append((bucket, at))
            at = int(leave[at])
        return pa.table({"bucket": pa.array([r[0] for r in out], pa.int64()), "enter": pa.array([r[1] for r in out], pa.int64())})

    kind = "bucket bigint, enter bigint, leave bigint"
    levels = [spread.groupBy("bucket").applyInArrow(exits, kind)]
    last = rows.agg(F.max("position")).first()[0] or 1
    buckets = (last - 1) // bucket + 1
    while buckets > 1:
        levels.append(levels[-1].withColumn("up", F.floor(F.col("bucket") / FANOUT)).groupBy("up").applyInArrow(lambda table: compose(table.drop(["up"])), kind))
        buckets = -(-buckets // FANOUT)
    starts = rows.sparkSession.createDataFrame([(0, 0)], "bucket bigint, enter bigint")
    for maps in reversed(levels[:-1]):
        above = starts.select(F.col("bucket").alias("up"), F.col("enter").alias("start"))
        below = maps.withColumn("up", F.floor(F.col("bucket") / FANOUT)).join(above, "up")
        starts = below.groupBy("up").applyInArrow(lambda keys, table: descend(keys, table.drop(["up"])), "bucket bigint, enter bigint")

    def lay_out(keys, table):
        _, position, sizes, jump, inside = walk(table.drop(["enter"]))
        i, out = table["enter"][0].as_py(), []
        while i < inside:
            j = int(jump[i])
            out.append((position[i], position[j - 1], j - i, int(sizes[i:j].sum())))
            i = j
        cols = list(zip(*out)) or [[], [], [], []]
        names = ("first_position", "last_position", "records", "bytes")
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols)})

    pages = spread.join(starts, "bucket").groupBy("bucket").applyInArrow(lay_out, "first_position bigint, last_position bigint, records bigint, bytes bigint")
    from tidemark.operators.ordering import with_rank

    return with_rank(pages, "first_position", "page")


def conflicting_ids(plan: DataFrame, saved: DataFrame) -> DataFrame:
    """Plan records whose id is saved with another position or payload."""
    s = saved.select(F.col("record_id"), F.col("position").alias("__p"), F.col("payload").alias("__b"))
    return plan.join(s, "record_id").filter("position <> __p OR NOT payload <=> __b").drop("__p", "__b").distinct()


def is_exact_replay(plan: DataFrame, saved: DataFrame) -> DataFrame:
    """One row: rows of each side without an equal on the other; both 0 for an exact replay. One aggregation decides."""
    cols = ["position", "record_id", "payload"]
    both = plan.select(*cols, F.lit(1).alias("__s")).unionByName(saved.select(*cols, F.lit(-1).alias("__s")))
    balance = both.groupBy(*cols).agg(F.sum("__s").alias("d"))
    return balance.agg(
        F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).cast("bigint").alias("only_plan"),
        F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_saved"),
    ).withColumn("exact", F.expr("only_plan = 0 AND only_saved = 0"))


def append_plan(incoming: DataFrame, saved: DataFrame, head: int) -> DataFrame:
    """Positions for records (``seq``, ``record_id``, ``payload``) that are new; equal ones are quiet.

    ``saved`` has the ids with their payload, or with its SHA-256 as ``digest``. ``refusal`` is set for other bytes under a known id, and
    for oversized payloads.
    """
    from tidemark.operators.ordering import with_rank

    by_digest = "digest" in saved.columns

    first = incoming.groupBy("record_id").agg(F.min("seq").alias("seq"), F.min_by("payload", "seq").alias("payload"), F.count_distinct("payload").alias("kinds"))
    known = saved.select("record_id", F.col("digest" if by_digest else "payload").alias("__saved"))
    own = F.unhex(F.sha2("payload", 256)) if by_digest else F.col("payload")
    marked = first.join(known, "record_id", "left").withColumn(
        "refusal",
        F.when(F.octet_length("payload") > MAX_APPEND_BYTES, "OversizedRecord").when(
            (F.col("kinds") > 1) | (F.col("__saved").isNotNull() & (F.col("__saved") != own)), "ConflictingRecord"
        ),
    )
    # New and refused rows go through one plan; a refused row is told even if it has no ``seq``.
    told = marked.filter("refusal IS NOT NULL OR __saved IS NULL")
    told = told.withColumn("seq", F.when(F.col("refusal").isNotNull(), F.coalesce("seq", F.lit(0))).otherwise(F.col("seq")))
    good = F.col("refusal").isNull()
    placed = with_rank(told, "seq", "place", only=good)
    return placed.select("record_id", "payload", F.when(good, F.col("place") + head).alias("position"), "refusal")


def duplicate_bytes(received: DataFrame, seen: int) -> DataFrame:
    """Bytes and records that arrived at or below the highest position seen."""
    again = F.col("position") <= seen
    return received.agg(
        F.coalesce(F.sum(F.when(again, F.col("size"))), F.lit(0)).cast("bigint").alias("duplicate_bytes"),
        F.count_if(again).alias("duplicate_records"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("payload_bytes"),
    )
