"""Pins as rows: leases of any number of holders, appended, newest by holder, with the least live position as an aggregate.

The list of runs is part of the state of the table that the pins hold back, so a pin and the floor that it was checked against are one
commit. A refresh appends one row; runs of one level are merged once ``FANIN`` have come together, which leaves out rows that were
refreshed or have expired. An expired pin can only be registered anew, so nothing refers to its row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.commitlog import FANIN, CommitLog

_SCHEMA = "holder string, completed bigint, expires_at_ms bigint, revision bigint"


def _newest(rows: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("completed", "expires_at_ms", "revision"), F.struct("expires_at_ms", "revision"))
    return rows.groupBy("holder").agg(newest.alias("p")).select("holder", "p.*")


class PinRuns:
    """The runs named in a state, below the folder of a log."""

    def __init__(self, log: CommitLog, runs: list[dict]):
        self.log, self.runs = log, runs

    def _rows(self, runs: list[dict]) -> DataFrame:
        paths = [f"{self.log.path}/pins/{r['name']}" for r in runs]
        return self.log.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.log.spark.createDataFrame([], _SCHEMA)

    def pins(self) -> DataFrame:
        """``holder``, ``completed``, ``expires_at_ms``, ``revision`` of every pin, live or not."""
        return _newest(self._rows(self.runs))

    def find(self, holder: str) -> dict | None:
        row = _newest(self._rows(self.runs).filter(F.col("holder") == holder)).first()
        return row.asDict() if row else None

    def live_span(self, now_ms: int) -> tuple[int, int] | None:
        """The least and the greatest position held by a live pin."""
        row = self.pins().filter(F.col("expires_at_ms") > now_ms).agg(F.min("completed").alias("low"), F.max("completed").alias("high")).first()
        return None if row["low"] is None else (row["low"], row["high"])

    def _write(self, rows: DataFrame, level: int) -> dict:
        run = {"name": f"run-{uuid.uuid4().hex}", "level": level}
        rows.select("holder", "completed", "expires_at_ms", "revision").write.parquet(f"{self.log.path}/pins/{run['name']}")
        return run

    def added(self, rows: DataFrame, now_ms: int) -> list[dict]:
        """The runs with these rows; full levels are merged."""
        runs, level = [*self.runs, self._write(rows, 0)], 0
        while len(full := [r for r in runs if r["level"] == level]) >= FANIN:
            merged = _newest(self._rows(full)).filter(F.col("expires_at_ms") > now_ms)
            runs = [r for r in runs if r["level"] != level] + [self._write(merged, level + 1)]
            level += 1
        return runs


def batch_refusals(incoming: DataFrame, saved: DataFrame, floor: int, head: int, now_ms: int) -> DataFrame:
    """``incoming`` (``holder``, ``completed``, ``expires_at_ms``) with ``revision`` and ``refusal``, by the rules of a single registration.

    A holder that comes several times is an InvalidPlan.
    """
    once = incoming.groupBy("holder").agg(F.count("*").alias("__n"), F.min("completed").alias("completed"), F.min("expires_at_ms").alias("expires_at_ms"))
    old = saved.select("holder", F.col("expires_at_ms").alias("__until"), F.col("revision").alias("__revision"))
    refusal = (
        F.when(F.col("__n") > 1, "InvalidPlan").when(F.col("__until") > now_ms, "Exists")
        .when(F.col("completed").isNull() | ~F.col("completed").between(floor, head), "PinOutOfRange").when(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") <= now_ms), "Expired")
    )
    told = once.join(old, "holder", "left").withColumns({"refusal": refusal, "revision": F.coalesce("__revision", F.lit(0)) + 1})
    return told.select("holder", "completed", "expires_at_ms", "revision", "refusal")

