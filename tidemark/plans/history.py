"""History on demand: fetch a tail or an older page, validate it whole, install it."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import history as windows
from tidemark.operators.history import HydrationQueue
from tidemark.schema import Limits, Refusal, Scope
from tidemark.sources.ports import HistorySource, HistoryStore
from tidemark.sources.streams import StreamsReplica


def check_history(rows: DataFrame, first: int, last: int, oldest: int, limits: Limits) -> None:
    """Refuse rows that are not exactly the positions from first to last, or that are over budget. One aggregation over a page."""
    size = F.octet_length("payload")
    row = rows.agg(
        F.count("*").alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.count_distinct("position").alias("places"),
        F.count_distinct("record_id").alias("ids"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.coalesce(F.max(size), F.lit(0)).alias("largest"),
    ).first()
    if first + row["n"] - 1 != last or oldest > first:
        raise Refusal("InvalidBoundary")
    if row["n"] > limits.records or row["bytes"] > limits.total_bytes or row["largest"] > limits.record_bytes:
        raise Refusal("BoundsExceeded")
    if row["ids"] != row["n"]:
        raise Refusal("WrongRecord")
    if row["n"] and (row["lo"], row["hi"], row["places"]) != (first, last, row["n"]):
        raise Refusal("Noncontiguous")


def fetch_tail(scope: Scope, limits: Limits, access: Any, source: HistorySource, store: HistoryStore) -> dict:
    """Install the newest records under the next generation; returns the progress."""
    access.authorize(scope)
    before = store.progress()
    tail = source.tail(scope, limits)
    check_history(tail["rows"], tail["first"], tail["watermark"], tail["oldest"], limits)
    access.authorize(scope)
    return store.install_tail(scope, before["generation"] + 1 if before else 1, tail)


def fetch_older(scope: Scope, limits: Limits, access: Any, source: HistorySource, store: HistoryStore) -> dict:
    """Install the page before what is loaded; the page must end exactly there."""
    access.authorize(scope)
    before = store.progress()
    if not before:
        raise Refusal("Stale")
    if before["lower_bound"] <= before["oldest_available"]:
        return before
    page = source.older(scope, before["lower_bound"], limits)
    if page["before"] != before["lower_bound"]:
        raise Refusal("WrongRequest")
    check_history(page["rows"], page["first"], page["before"] - 1, page["oldest"], limits)
    access.authorize(scope)
    return store.install_older(scope, before["generation"], page)


def hydrate(scope: Scope, queue: HydrationQueue, limits: Limits, access: Any, source: HistorySource, store: HistoryStore) -> dict:
    """Fetch a tail if nothing is loaded, then older pages until no need of the queue waits or nothing older is left."""
    progress = store.progress() or fetch_tail(scope, limits, access, source, store)
    while queue.next_target(progress["lower_bound"]) is not None and progress["lower_bound"] > progress["oldest_available"]:
        progress = fetch_older(scope, limits, access, source, store)
    queue.resolve(progress["lower_bound"])
    return progress


def _pages(rows: DataFrame, streams: DataFrame) -> DataFrame:
    """``streams`` with what their rows come to: refused unless they are exactly ``first`` to ``last``, each record once."""
    seen = rows.groupBy("stream").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("high"), F.count_distinct("position").alias("places"))
    whole = (F.col("high") == F.col("last")) & (F.col("high") - F.col("first") + 1 == F.col("n")) & (F.col("places") == F.col("n"))
    refusal = F.when(F.col("n").isNull(), "OversizedRecord").when(~whole, "Noncontiguous")
    return streams.join(seen, "stream", "left").withColumn("refusal", refusal).drop("n", "high", "places")


def hydrate_streams(source: DataFrame, targets: DataFrame, limits: Limits, store: StreamsReplica, floors: DataFrame | None = None) -> DataFrame:
    """Hydrate many streams at once: tails of those with nothing loaded, then older pages of all that are still above their target.

    ``source`` has the rows of all streams (``stream``, ``position``, ``record_id``, ``payload``), ``targets`` ``stream`` and ``lower_target``,
    ``floors`` ``stream`` and ``floor`` where rows have been pruned. A round is one plan over all streams that still want; a page is cut within
    the budgets of each stream, below the shuffle, so a stream that has most of the rows sends pages, not itself. Returns ``stream`` and
    ``refusal`` of the streams that could not go on; rounds end when none wants or can.
    """
    size, stopped = F.octet_length("payload"), None
    wanted = targets.groupBy("stream").agg(F.min("lower_target").alias("lower_target"))
    floors = floors if floors is not None else wanted.select("stream", F.lit(0).cast("bigint").alias("floor"))
    rows = source.select("stream", "position", "record_id", "payload").join(wanted.select("stream"), "stream", "left_semi")
    rows = rows.join(floors, "stream", "left").filter(F.col("position") > F.coalesce("floor", F.lit(0)))

    def install(pages: DataFrame, part: DataFrame, put) -> None:
        nonlocal stopped
        pages = pages.persist()
        good = pages.filter("refusal IS NULL").drop("refusal")
        told = put(good, part.join(good.select("stream"), "stream", "left_semi"))
        bad = pages.select("stream", "refusal").unionByName(told).filter("refusal IS NOT NULL")
        if not bad.isEmpty():
            path = f"{store.log.path}/refused/{uuid.uuid4().hex}"
            bad.write.parquet(path)
            found = store.spark.read.schema(bad.schema).parquet(path)
            stopped = found if stopped is None else stopped.unionByName(found)
        pages.unpersist()

    fresh = wanted.join(store.progress().select("stream"), "stream", "left_anti")
    if not fresh.isEmpty():
        tails = windows.tails(rows.join(fresh.select("stream"), "stream", "left_semi"), "stream", "position", size, limits)
        part = rows.join(tails.filter("refusal IS NULL").select("stream", F.col("first").alias("__first")), "stream").filter(F.col("position") >= F.col("__first"))
        heads = tails.select("stream", F.col("watermark").alias("last")).join(floors, "stream", "left")
        pages = _pages(part, heads).withColumns({"watermark": F.col("last"), "oldest": F.coalesce("floor", F.lit(0)) + 1, "expected": F.lit(None).cast("bigint")})
        install(pages, part, store.install_tails)
    while True:
        going = store.progress().filter("NOT deleted").join(wanted, "stream").filter(F.col("lower_bound") > F.greatest("lower_target", "oldest_available"))
        if stopped is not None:
            going = going.join(stopped, "stream", "left_anti")
        going = going.select("stream", "lower_bound", "oldest_available", F.col("version").alias("expected"))
        if going.isEmpty():
            break
        near = rows.join(going.select("stream", F.col("lower_bound").alias("__before")), "stream")
        part = windows.older_pages(near, "stream", "position", F.col("__before"), size, limits)
        pages = _pages(part, going.select("stream", (F.col("lower_bound") - 1).alias("last"), F.col("oldest_available").alias("oldest"), "expected"))
        install(pages, part, store.install_older)
    return stopped if stopped is not None else store.spark.createDataFrame([], "stream string, refusal string")
