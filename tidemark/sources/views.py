"""Plain tables as history and catalogue sources: nothing is copied into a durable table first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import catalogue, history
from tidemark.operators.records import Positioned
from tidemark.schema import PROOFS, Limits, Refusal, Scope


class RecordView:
    """A history source over records with dense positions; ranges reach the scan as filters on the raw column.

    The head is that of the table when a read begins; rows at or below ``floor`` are not shown. An empty table has an empty tail.
    """

    def __init__(self, table: Positioned, scope: Scope, floor: int = 0):
        self.table, self.scope, self.floor = table, scope, floor

    def _match(self, scope: Scope) -> None:
        if (scope.origin, scope.stream, scope.incarnation, scope.schema_id) != (self.scope.origin, self.scope.stream, self.scope.incarnation, self.scope.schema_id):
            raise Refusal("IdentityChanged")

    def _rows(self, after: int, target: int) -> DataFrame:
        return self.table.between(after, target).select("position", "record_id", F.col("payload").cast("binary").alias("payload"))

    def _head(self) -> int:
        return self.table.head().first()["head"]

    def tail(self, scope: Scope, limits: Limits) -> dict:
        self._match(scope)
        head = self._head()
        if not head:
            return {"first": 1, "watermark": 0, "oldest": 1, "rows": self._rows(0, 0)}
        near = self._rows(max(self.floor, head - limits.capped().records), head)
        top = history.tails(near.withColumn("stream", F.lit(scope.stream)), "stream", "position", F.octet_length("payload"), limits).first()
        if top is None or top["refusal"]:
            raise Refusal(top["refusal"] if top else "ResetRequired")
        return {"first": top["first"], "watermark": head, "oldest": self.floor + 1, "rows": near.filter(F.col("position") >= top["first"])}

    def older(self, scope: Scope, before: int, limits: Limits) -> dict:
        self._match(scope)
        last = min(before - 1, self._head())
        near = Positioned(self._rows(max(self.floor, last - limits.capped().records), last).withColumnRenamed("position", "raw"), "raw")
        rows = history.older_page(near, before, self.floor, limits, F.octet_length("payload")).select("position", "record_id", "payload")
        first = rows.agg(F.min("position")).first()[0]
        if first is None:
            raise Refusal("ResetRequired")
        return {"first": first, "before": before, "oldest": self.floor + 1, "rows": rows}


class CatalogueView:
    """A catalogue source over a table of current states (``entry_id``, ``creation``, ``revision``, ``deleted``, ``payload``, ``visible``).

    The table does not change while the view is used; every read is a range of creations, which a table in their order answers from few
    files. How wide a range must be for a page is learned from the page before.
    """

    def __init__(self, spark: SparkSession, states: DataFrame, scope: Scope, head: int, horizon: int = 0, proofs: DataFrame | None = None):
        self.spark, self.scope, self._states = spark, scope, states
        self._head, self._horizon, self._width = head, horizon, 0
        self._proofs = proofs if proofs is not None else spark.createDataFrame([], PROOFS)

    def snapshot(self) -> None:
        """There is one version only."""

    def head(self, at: None = None) -> int:
        return self._head

    def horizon(self, at: None = None) -> int:
        return self._horizon

    @staticmethod
    def _between(rows: DataFrame, low: int, high: int) -> DataFrame:
        return rows.filter((F.col("creation") >= low) & (F.col("creation") <= high))

    def manifest_page(self, boundary: int, completed: int, cursor: tuple[int, str] | None, limit: int, at: None = None) -> tuple[list, int]:
        begin = low = cursor[0] if cursor else 1
        width, found, ranges = max(self._width, limit + 1), [], 0
        while low <= boundary and len(found) <= limit:
            high = min(low + width - 1, boundary)
            found += catalogue.manifest(self._between(self._states, low, high), boundary, completed, cursor, limit).collect()  # limit + 1 descriptors at most
            ranges, low, width = ranges + 1, high + 1, width * 4
        if len(found) > limit:
            self._width = 2 * (found[limit]["creation"] - begin + 1)
        return found[: limit + 1], ranges

    def manifest_span(self, boundary: int, completed: int, cursor: tuple[int, str] | None, rows: int, at: None = None) -> DataFrame:
        low, width = cursor[0] if cursor else 1, rows
        while True:
            high = min(low + width - 1, boundary)
            found = catalogue.shown(self._between(self._states, low, high), boundary, completed, cursor)
            if high == boundary or found.count() >= rows:
                return found
            width *= 4

    def states(self, low: int, high: int, at: None = None) -> tuple[DataFrame, DataFrame]:
        return self._between(self._states, low, high), self._between(self._proofs, low, high)
