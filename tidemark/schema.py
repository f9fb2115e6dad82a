"""Data model: identities, limits, requests and the table schemas of the engine.

Positions, revisions and generations are BIGINT; ANSI arithmetic refuses to overflow, and ``columns.checked_add`` says so. Payloads are opaque.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Storage and wire bounds of the data model.
MAX_ID_BYTES = 128
MAX_PAGE_RECORDS = 256
MAX_PAGE_BYTES = 1 << 20
MAX_APPEND_BYTES = 512 << 10
MAX_CATALOGUE_ENTRIES = 256
MAX_CHUNK_BYTES = 64 << 10
MAX_COMPACTION_BATCH = 256
MAX_WAITERS = 256
MAX_PINS = 4096
HEAD_VERSION = 1
HORIZON_VERSION = 2
WIRE_PAGE_RECORDS = 64
WIRE_PAGE_BYTES = 512 << 10
WIRE_CATALOGUE_ENTRIES = 128
MAX_FRAME_BYTES = 1 << 20


class Refusal(Exception):
    """A typed refusal; ``code`` names its kind."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def check_id(text: str) -> str:
    """An identity: not blank and at most 128 bytes, never normalised."""
    if len(text.encode()) > MAX_ID_BYTES or not text.strip():
        raise Refusal("InvalidId")
    return text


@dataclass(frozen=True)
class Scope:
    """Six-part identity; equality is exact over all parts."""

    receiver: str
    origin: str
    stream: str
    incarnation: str
    schema_id: str
    access_epoch: str

    def __post_init__(self) -> None:
        for part in (self.receiver, self.origin, self.stream, self.incarnation, self.schema_id, self.access_epoch):
            check_id(part)

    @property
    def target(self) -> tuple[str, str, str]:
        """The stable target that a reset keeps."""
        return self.receiver, self.origin, self.stream


@dataclass(frozen=True)
class Limits:
    """Nonzero budgets of one page."""

    records: int
    total_bytes: int
    record_bytes: int

    def __post_init__(self) -> None:
        if min(self.records, self.total_bytes, self.record_bytes) <= 0:
            raise Refusal("InvalidLimits")

    def capped(self, records: int = MAX_PAGE_RECORDS, size: int = MAX_PAGE_BYTES) -> "Limits":
        """The budgets under an adapter's physical caps."""
        return Limits(min(self.records, records), min(self.total_bytes, size), min(self.record_bytes, size))


@dataclass(frozen=True)
class PageRequest:
    scope: Scope
    after: int
    target: int
    limits: Limits


@dataclass(frozen=True)
class SourceHead:
    """A committed position with requirement masks."""

    scope: Scope
    position: int
    reader_required: int = 0
    writer_required: int = 0
    version: int = HEAD_VERSION


SCOPE = T.StructType([T.StructField(n, T.StringType(), False) for n in ("receiver", "origin", "stream", "incarnation", "schema_id", "access_epoch")])
_LONG, _TEXT, _BYTES, _FLAG = T.LongType(), T.StringType(), T.BinaryType(), T.BooleanType()


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


RECORDS = _table(("position", _LONG, False), ("record_id", _TEXT, False), ("payload", _BYTES, False))
STREAMS = _table(*[(f.name, _TEXT, False) for f in SCOPE], ("position", _LONG, False))
HISTORY = _table(
    ("receiver", _TEXT, False), ("origin", _TEXT, False), ("stream", _TEXT, False), ("generation", _LONG, False),
    ("live_head", _LONG, False), ("lower_bound", _LONG, False), ("oldest_available", _LONG, False), ("deleted", _FLAG, False),
)
ENTRIES = _table(("entry_id", _TEXT, False), ("creation", _LONG, False), ("revision", _LONG, False), ("deleted", _FLAG, False), ("payload", _BYTES, True), ("visible", _FLAG, False))
PROOFS = _table(("entry_id", _TEXT, False), ("creation", _LONG, False), ("revision", _LONG, False))
PINS = _table(("kind", _TEXT, False), ("origin", _TEXT, False), ("resource", _TEXT, False), ("incarnation", _TEXT, False), ("holder", _TEXT, False), ("completed", _LONG, False), ("expires_at_ms", _LONG, False))
ARTIFACTS = _table(
    ("artifact_id", _TEXT, False), ("revision", _LONG, False), ("deleted", _FLAG, False), ("length", _LONG, False), ("digest", _TEXT, False),
    ("offset", _LONG, True), ("bytes", _BYTES, True),
)
STAGED = _table(
    ("artifact_id", _TEXT, False), ("version", _LONG, False), ("kind", _TEXT, False), ("revision", _LONG, False), ("deleted", _FLAG, True),
    ("length", _LONG, True), ("digest", _TEXT, True), ("offset", _LONG, True), ("bytes", _BYTES, True),
)
STREAM_ROWS = _table(
    ("kind", _TEXT, False), ("stream", _TEXT, True), ("position", _LONG, True), ("record_id", _TEXT, True), ("payload", _BYTES, True),
    ("generation", _LONG, True), ("live_head", _LONG, True), ("lower_bound", _LONG, True), ("oldest_available", _LONG, True), ("deleted", _FLAG, True), ("version", _LONG, True),
)
CHUNKS = _table(("artifact_id", _TEXT, False), ("offset", _LONG, False), ("bytes", _BYTES, False))
EPOCHS = _table(("authority", _TEXT, False), ("epoch", _LONG, False))
