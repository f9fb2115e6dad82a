"""Ports of the coordinators: what a history, catalogue or artifact store must offer to take part.

The durable tables implement them; so may anything else, such as the views of plain tables in ``views.py``.
"""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from tidemark.schema import Limits, Scope


class HistorySource(Protocol):
    def tail(self, scope: Scope, limits: Limits) -> dict:
        """``first``, ``watermark``, ``oldest`` and the ``rows`` of the newest records of one snapshot."""

    def older(self, scope: Scope, before: int, limits: Limits) -> dict:
        """``first``, ``before``, ``oldest`` and the ``rows`` that end just before a position."""


class HistoryStore(Protocol):
    def progress(self) -> dict | None: ...

    def install_tail(self, scope: Scope, generation: int, tail: dict) -> dict: ...

    def install_older(self, scope: Scope, generation: int, page: dict) -> dict: ...

    def fence_deletion(self, scope: Scope) -> dict: ...


class CatalogueSource(Protocol):
    spark: SparkSession

    def snapshot(self) -> Any:
        """A version that the reads of one step share."""

    def head(self, at: Any = None) -> int: ...

    def horizon(self, at: Any = None) -> int: ...

    def manifest_page(self, boundary: int, completed: int, cursor: tuple[int, str] | None, limit: int, at: Any = None) -> tuple[list, int]:
        """At most ``limit`` + 1 descriptors in (creation, id) order, and how many files or ranges were read for them."""

    def manifest_span(self, boundary: int, completed: int, cursor: tuple[int, str] | None, rows: int, at: Any = None) -> DataFrame:
        """Descriptors of all entries of a range after the cursor, in no order: at least ``rows``, unless they end before."""

    def states(self, low: int, high: int, at: Any = None) -> tuple[DataFrame, DataFrame]:
        """Entries and proofs whose creations are in low to high."""


class CatalogueStore(Protocol):
    def progress(self) -> Any: ...

    def entries(self, at: Any = None) -> DataFrame: ...

    def entries_between(self, low: int, high: int, at: Any = None) -> DataFrame: ...

    def save(
        self, expected: Any, after: Any, rows: DataFrame | None = None, replace_rows: bool = False, horizon: int | None = None, recovery: dict | None = None, few: bool = True
    ) -> Any:
        """Progress, rows, horizon and the phase of a recovery in one commit, if progress is as expected. ``few``: the rows are a page at most."""


class RecoveryStore(CatalogueStore, Protocol):
    log: Any

    def recovery(self) -> Any: ...

    def candidates(self) -> DataFrame: ...

    def floors_between(self, low: int, high: int) -> DataFrame: ...

    def next_candidates(self, after: int, limit: int) -> tuple[list, int | None]: ...

    def save_candidates(self, rows: DataFrame) -> str: ...


class ChunkSource(Protocol):
    def manifest(self, artifact_id: str) -> dict: ...

    def chunk(self, artifact_id: str, revision: int, offset: int, size: int) -> bytes: ...


class TransferStore(Protocol):
    def accept(self, artifact_id: str, revision: int, length: int, digest: str, deleted: bool = False) -> dict: ...

    def append(self, artifact_id: str, offset: int, data: bytes) -> dict: ...

    def publish(self, artifact_id: str) -> dict: ...
