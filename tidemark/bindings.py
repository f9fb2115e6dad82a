"""How the driver tables play the engine's streams, logs, artifacts and pins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.records import Positioned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_payload():
    return F.concat("event_type", F.lit("|"), F.coalesce("props", F.lit("")))


def event_records(spark: SparkSession, sf_dir: str) -> Positioned:
    """Events as one record stream: position is event_id + 1."""
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("record_id"), _event_payload().alias("payload"))
    return Positioned(rows, "event_id", 1)


def document_records(spark: SparkSession, sf_dir: str) -> Positioned:
    """Documents as a byte-heavy record stream: position is doc_id + 1."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("size"))
    return Positioned(d, "doc_id", 1)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as many streams."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id", (F.col("turn") + 1).alias("position"), F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("record_id"),
        "role", F.coalesce("text", F.lit("")).alias("payload"),
    )


def mutation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user as a catalogue's mutations; some users' errors delete them."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entry_id"),
        ((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0)).alias("is_del"), _event_payload().alias("payload"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as pin holders: completed is their highest position, expiry follows from it."""
    e = table(spark, sf_dir, "events")
    held = e.groupBy("user_id").agg((F.max("event_id") + 1).alias("completed"))
    return held.select(
        (F.col("user_id") % 4).alias("resource"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("holder"),
        "completed", (F.col("completed") % 97).alias("expires_at_ms"),
    )
