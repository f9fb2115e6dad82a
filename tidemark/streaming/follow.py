"""Incremental catch-up with Structured Streaming.

A file stream runs over what is there now (``availableNow``) in micro-batches of bounded size;
every batch is committed under the id of its checkpoint and its own, so a repeated batch changes nothing, and
a stream with another checkpoint counts its batches anew.

Mutations that arrive out of order are held back, entry by entry, in keyed state until the watermark on their sequence number
has passed them; those that arrive behind it are refused with a code.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from tidemark.schema import Refusal
from tidemark.sources.commitlog import CommitLog
from tidemark.sources.datasource import stream_table
from tidemark.sources.tables import CatalogueTable


def follow(spark: SparkSession, source: str, schema: StructType, target: CommitLog, checkpoint: str, max_files: int = 64, max_bytes: str | None = None) -> int:
    """Bring ``target`` up to all files below ``source``; returns the number of batches that added rows."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return _follow(spark, reader.parquet(source), target, checkpoint)


def follow_table(spark: SparkSession, kind: str, source: str, target: CommitLog, checkpoint: str, **options: str | int) -> int:
    """Bring ``target`` up to the record or catalogue table at ``source``; returns the number of batches that added rows.

    A run is one batch of what was committed since the run before; its offset, a position or revision, is in the checkpoint.
    """
    return _follow(spark, stream_table(spark, kind, source, **options), target, checkpoint)


def _follow(spark: SparkSession, arrivals: DataFrame, target: CommitLog, checkpoint: str) -> int:
    added, origin = 0, None

    def save(batch: DataFrame, batch_id: int) -> None:
        nonlocal added, origin
        if origin is None:  # Spark writes the id of the query when it makes the checkpoint
            origin = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        at = target.snapshot()
        saved = at.state.get("batches", {})
        if saved.get(origin, -1) >= batch_id:
            return
        try:
            target.commit(at, at.state | {"batches": saved | {origin: batch_id}}, batch)
        except Refusal as refusal:
            # Another attempt of this very batch may have won.
            if refusal.code != "Stale" or target.snapshot().state.get("batches", {}).get(origin, -1) < batch_id:
                raise
            return
        added += 1

    query = arrivals.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return added


#: Refusals that ``fold`` tells of: behind the watermark, and other contents under a sequence number that an entry has waiting.
LATE, CONFLICTING = "Stale", "InvalidPlan"
_ORDERED = "seq bigint, entry_id string, is_del boolean, payload binary, refusal string"


class InOrder(StatefulProcessor):
    """Holds the mutations of an entry until the watermark passes them, then hands them on in order.

    The state has what waits and nothing else, read and written once for an entry and batch; a repeated mutation is handed on once.
    Times are sequence numbers plus one, since a watermark begins at 0.
    """

    COLUMNS = ["seq", "entry_id", "is_del", "payload", "refusal"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq bigint, is_del boolean, payload binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        passed = timerValues.getCurrentWatermarkInMs()
        refused, fresh = [], []
        for part in rows:
            for seq, is_del, payload in zip(part["seq"].tolist(), part["is_del"].tolist(), part["payload"].tolist()):
                value = (seq, bool(is_del), None if payload is None else bytes(payload))
                if seq < passed:
                    refused.append((seq, key[0], *value[1:], LATE))
                else:
                    fresh.append(value)
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(fresh)[0] + 1)
        if refused:
            yield pd.DataFrame(refused, columns=self.COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(((r[0], bool(r[1]), None if r[2] is None else bytes(r[2])) for r in self.waiting.get()), key=lambda r: r[0]) if self.waiting.exists() else []
        told: dict[int, tuple] = {}
        out = []
        for row in held:
            if row[0] >= passed:
                break
            if told.setdefault(row[0], row) is row:
                out.append((row[0], key[0], *row[1:], None))
            elif told[row[0]] != row:
                out.append((row[0], key[0], *row[1:], CONFLICTING))
        rest = [row for row in held if row[0] >= passed]
        if out:
            self.waiting.put(rest) if rest else self.waiting.clear()
            if rest:
                self.handle.registerTimer(rest[0][0] + 1)
            yield pd.DataFrame(out, columns=self.COLUMNS)

    def close(self) -> None:
        pass


def in_order(mutations: DataFrame, lateness: int) -> DataFrame:
    """A stream of mutations, each handed on once one more than ``lateness`` ahead of it was seen, with ``refusal`` for late ones.

    The event time is the sequence number plus one, in milliseconds. Rows without an entry only move the watermark.
    """
    timed = mutations.withColumn("__at", F.timestamp_millis(F.col("seq") + 1)).withWatermark("__at", f"{lateness} milliseconds")
    # Without the time column Spark leaves late rows to the processor, which refuses them by name. It passes over rows without an entry,
    # too: a filter here would be moved below the watermark, which then would not see them.
    rows = timed.select("seq", "entry_id", "is_del", F.col("payload").cast("binary").alias("payload"))
    return rows.groupBy("entry_id").transformWithStateInPandas(InOrder(), _ORDERED, "Append", "EventTime")


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers needs the store on disk."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def fold(
    spark: SparkSession, source: str, schema: StructType, table: CatalogueTable, checkpoint: str, lateness: int, max_files: int = 64, refused: str | None = None
) -> int:
    """Fold a stream of mutations (files below ``source``) into a catalogue; returns its head.

    Mutations may come up to ``lateness`` sequence numbers late. A batch of those whose turn has come is applied, in order, together with
    its id, so a repeated batch changes nothing. Late ones, with their ``refusal``, go to a folder of their batch below ``refused``. What the
    watermark has not passed waits in the checkpoint for the next run; a row without an entry moves the watermark on.
    """
    origin = None

    def save(batch: DataFrame, batch_id: int) -> None:
        nonlocal origin
        if origin is None:
            origin = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        saved = table.snapshot().state.get("batches", {})
        if saved.get(origin, -1) >= batch_id:
            return
        batch = batch.persist()
        try:
            late = batch.filter("refusal IS NOT NULL")
            if refused and not late.isEmpty():
                late.write.mode("overwrite").parquet(f"{refused}/batch={batch_id}")
            table.apply(batch.filter("refusal IS NULL").drop("refusal"), mark={"batches": saved | {origin: batch_id}})
        finally:
            batch.unpersist()

    with _keyed_state(spark):
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
        in_order(reader, lateness).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.head()


def hint_heads(arrivals: DataFrame, stream: str, head: str, arrived: str, window: str, late: str) -> DataFrame:
    """Coalesce wake hints of a stream of arrivals: the highest head by stream and window; hints later than ``late`` are dropped, which is safe: a hint is never progress."""
    timed = arrivals.withWatermark(arrived, late)
    return timed.groupBy(stream, F.window(arrived, window)).agg(F.max(head).alias("head"), F.count("*").alias("hints"))


class Rising(StatefulProcessor):
    """Hands on the windows of a stream whose head is above all heads before; the state is one number for each stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.highest = handle.getValueState("highest", "head bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        seen = self.highest.get()[0] if self.highest.exists() else None
        table = pd.concat(list(rows)).sort_values("opened", kind="stable")
        before = table["head"].cummax().shift(1)
        before = before if seen is None else before.fillna(seen).clip(lower=seen)
        rising = before.isna() | (table["head"] > before)
        self.highest.update((int(max(table["head"].max(), seen if seen is not None else table["head"].max())),))
        if rising.any():
            yield table[rising][["stream", "opened", "head", "hints"]]

    def close(self) -> None:
        pass


def rising_hints(arrivals: DataFrame, stream: str, head: str, arrived: str, window: str, late: str) -> DataFrame:
    """``stream``, ``opened`` (start of the window), ``head``, ``hints``: each window, once closed, whose head is news for its stream."""
    closed = hint_heads(arrivals, stream, head, arrived, window, late)
    rows = closed.select(F.col(stream).cast("string").alias("stream"), F.col("window.start").alias("opened"), F.col("head").cast("bigint").alias("head"), F.col("hints").cast("bigint").alias("hints"))
    return rows.groupBy("stream").transformWithStateInPandas(Rising(), "stream string, opened timestamp, head bigint, hints bigint", "Append", "None")


def follow_hints(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, stream: str, head: str, arrived: str, window: str, late: str, max_files: int = 64) -> None:
    """Write the rising heads of a stream of hints (files below ``source``) to ``target``, exactly once."""
    with _keyed_state(spark):
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
        hints = rising_hints(reader, stream, head, arrived, window, late)
        hints.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
