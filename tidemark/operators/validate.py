"""Validation of whole responses: every page gets the code of the first rule it breaks, or null.

``rows`` are the records or descriptors of many pages (``page``, ``ordinal`` from 1, …), ``requests`` has a row for
each page. Windows run inside a page, whose size the request bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.functions.columns import first_refusal


def _order() -> WindowSpec:
    return Window.partitionBy("page").orderBy("ordinal")


def _verdicts(rows: DataFrame, requests: DataFrame, rule: Column, before: Column, key: str) -> DataFrame:
    """Page rules first, then the first row that breaks a rule."""
    repeated = F.row_number().over(Window.partitionBy("page", key).orderBy("ordinal")) > 1
    joined = rows.join(requests, "page")
    if "size" in rows.columns:
        joined = joined.withColumn("sum", F.sum("size").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    marked = joined.withColumns({"repeated": repeated, "place": F.row_number().over(_order())}).withColumn("code", rule)
    broken = F.min(F.when(F.col("code").isNotNull(), F.struct("ordinal", "code")))
    found = marked.groupBy("page").agg(F.count("*").alias("count"), broken.alias("broken"))
    told = requests.join(found, "page", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return told.select("page", F.coalesce(before, F.col("broken.code")).alias("refusal"))


def pages(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Forward pages. Rows: position, record_id, size, same_scope; requests: after, target, max_records, max_bytes, max_record_bytes."""
    c = F.col
    before = first_refusal(
        ((c("target") <= c("after")) | (c("max_records") <= 0) | (c("max_bytes") <= 0) | (c("max_record_bytes") <= 0), "InvalidRange"),
        (c("count") == 0, "EmptyPage"),
        (c("count") > c("max_records"), "BoundsExceeded"),
    )
    expected = c("after") + c("place")
    rule = first_refusal(
        (~c("same_scope") | c("repeated"), "WrongRecord"),
        ((c("size") > c("max_record_bytes")) | ((c("place") == 1) & (c("size") > c("max_bytes"))), "OversizedRecord"),
        (c("sum") > c("max_bytes"), "BoundsExceeded"),
        ((c("position") != expected) | (expected > c("target")), "Noncontiguous"),
    )
    return _verdicts(rows, requests, rule, before, "record_id")


def history_pages(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Tails and older pages. Rows as for ``pages``; requests: generation, first, last, oldest, max_records, max_bytes, max_record_bytes.

    ``last`` is a tail's watermark, or one less than where an older page ends.
    """
    c = F.col
    before = first_refusal(
        ((c("generation") <= 0) | (c("max_records") <= 0) | (c("max_bytes") <= 0) | (c("max_record_bytes") <= 0), "InvalidRequest"),
        ((c("first") + c("count") - 1 != c("last")) | (c("oldest") > c("first")), "InvalidBoundary"),
        (c("count") > c("max_records"), "BoundsExceeded"),
    )
    rule = first_refusal(
        (~c("same_scope") | c("repeated"), "WrongRecord"),
        (c("position") != c("first") + c("place") - 1, "Noncontiguous"),
        ((c("size") > c("max_record_bytes")) | (c("sum") > c("max_bytes")), "BoundsExceeded"),
    )
    return _verdicts(rows, requests, rule, before, "record_id")


def manifests(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Manifest pages. Rows: entry_id, creation, revision; requests: completed, boundary, generation, cursor_creation, cursor_id, max_entries, has_more."""
    c = F.col
    before = first_refusal(
        ((c("boundary") <= c("completed")) | (c("generation") <= 0) | (c("max_entries") <= 0), "InvalidRequest"),
        (c("count") > c("max_entries"), "BoundsExceeded"),
        (c("has_more") & (c("count") == 0), "NoProgress"),
    )
    key = F.struct(c("creation").alias("a"), c("entry_id").alias("b"))
    cursor = F.when(c("cursor_creation").isNotNull(), F.struct(c("cursor_creation").alias("a"), c("cursor_id").alias("b")))
    previous = F.coalesce(F.lag(key).over(_order()), cursor)
    rule = first_refusal(
        ((c("creation") <= 0) | (c("revision") < c("creation")), "InvalidOrder"),
        ((c("creation") > c("boundary")) | (c("revision") <= c("completed")) | c("repeated"), "InvalidOrder"),
        (previous.isNotNull() & (key <= previous), "InvalidOrder"),
    )
    return _verdicts(rows, requests, rule, before, "entry_id")
