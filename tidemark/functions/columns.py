"""Column builders shared by the operators: sizes, checks, masks, codecs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import HEAD_VERSION, HORIZON_VERSION, MAX_ID_BYTES


def byte_length(value: Column) -> Column:
    return F.octet_length(value).cast("bigint")


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def id_refusal(value: Column) -> Column:
    """The code by which an identity is refused, or null. Blank counts all Unicode white space."""
    return F.when((F.octet_length(value) > MAX_ID_BYTES) | value.rlike(r"^[\s\p{Z}\x{85}]*$"), "InvalidId")


def first_refusal(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that holds, in order, or null."""
    return F.coalesce(*[F.when(condition, F.lit(code)) for condition, code in rules])


def missing_bits(required: Column, supported: Column | int) -> Column:
    support = F.lit(supported) if isinstance(supported, int) else supported
    return required.bitwiseAND(F.bitwise_not(support))


def reader_refusal(version: Column, required: Column, supported: int) -> Column:
    return first_refusal((version != HEAD_VERSION, "UnsupportedVersion"), (missing_bits(required, supported) != 0, "MissingReader"))


def writer_refusal(version: Column, reader: Column, writer: Column, reader_support: int, writer_support: int) -> Column:
    """Writers must understand both sets; readers ignore writer bits."""
    return F.coalesce(reader_refusal(version, reader, reader_support), first_refusal((missing_bits(writer, writer_support) != 0, "MissingWriter")))


def head_transition_refusal(before: str, after: str) -> Column:
    """The refusal of a publication ``after`` that follows ``before``; both name struct columns."""

    def b(name: str) -> Column:
        return F.col(f"{before}.{name}")

    def a(name: str) -> Column:
        return F.col(f"{after}.{name}")

    cleared = (missing_bits(b("reader_required"), a("reader_required")) != 0) | (missing_bits(b("writer_required"), a("writer_required")) != 0)
    within = first_refusal(
        (b("schema_id") != a("schema_id"), "SchemaChanged"),
        (a("position") < b("position"), "PositionRegressed"),
        (cleared, "RequirementsCleared"),
    )
    outer = first_refusal(
        ((b("version") != HEAD_VERSION) | (a("version") != HEAD_VERSION), "UnsupportedVersion"),
        ((b("origin") != a("origin")) | (b("stream") != a("stream")), "DifferentSource"),
    )
    return F.coalesce(outer, F.when(b("incarnation") == a("incarnation"), within))


def mask_to_bytes(mask: Column) -> Column:
    """An unsigned 64-bit mask as 8 big-endian bytes."""
    return F.unhex(F.lpad(F.hex(mask), 16, "0"))


def bytes_to_mask(value: Column) -> Column:
    """8 big-endian bytes as a signed BIGINT of the same bits."""
    digits = F.hex(value)
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def escape_html(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def text_field(payload: Column, at: Column | int) -> Column:
    """The text whose 2-byte big-endian length stands at a byte offset (from 0)."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.decode(F.substring(payload, at + 3, field_length(payload, at)), "UTF-8")


def field_length(payload: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(payload, at + 1, F.lit(2))), 16, 10).cast("int")


def encode_field(text: Column) -> Column:
    """A text field: 2-byte big-endian length, then the UTF-8 bytes."""
    data = F.encode(text, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data)), 4, "0")), data)


def access_refusal(decision: Column, same_scope: Column) -> Column:
    """Access decisions as refusals, checked before any local progress is shown."""
    return (
        F.when(decision == "Allowed", F.when(~same_scope, "WrongAccessScope"))
        .when(decision == "Denied", "Denied")
        .when(decision == "IdentityChanged", "WrongAccessScope")
        .when(decision == "InvalidResponse", "InvalidAccessResponse")
        .otherwise("Unverifiable")
    )


def open_page_refusal(after: Column, head: Column, records: Column) -> Column:
    """An open page's head is not behind the checkpoint, and it has no records exactly if there is nothing new."""
    return first_refusal((head < after, "SourceBehindCheckpoint"), ((head == after) & (records > 0), "Noncontiguous"), ((head > after) & (records == 0), "EmptyPage"))


def resolved_refusal(named: str, value: str, size: Column, max_bytes: int) -> Column:
    """Why a value does not answer the descriptor that named it; both name struct columns (creation, revision, deleted)."""
    from tidemark.operators.catalogue import transition_refusal

    return F.coalesce(
        transition_refusal(named, value),
        first_refusal((F.col(f"{value}.deleted") & (size > 0), "WrongPayload"), (size > max_bytes, "OversizedEntry")),
    )


def recovery_refusal(phase: Column, completed: Column, active_boundary: Column, boundary: Column) -> Column:
    """Enumeration has its pass from 0 to the boundary; the later phases have completed it."""
    running = (phase == "enumerate") & (completed == 0) & active_boundary.eqNullSafe(boundary)
    over = phase.isin("reconcile", "finish") & active_boundary.isNull() & (completed == boundary)
    return F.when(~(running | over), "InvalidRecovery")


def horizon_refusal(version: Column, horizon: Column, head: Column, previous: Column) -> Column:
    """A horizon comes in version 2, does not exceed its head and never falls."""
    return first_refusal((version != HORIZON_VERSION, "UnsupportedVersion"), (horizon > head, "InvalidHorizon"), (horizon < previous, "HorizonRegressed"))


def checked_add(value: Column, more: Column, name: str = "PositionOverflow") -> tuple[Column, Column]:
    """The sum of two BIGINTs, null where it overflows, and the code of that refusal."""
    total = F.try_add(value.cast("bigint"), more.cast("bigint"))
    return total, F.when(total.isNull() & value.isNotNull() & more.isNotNull(), name)
