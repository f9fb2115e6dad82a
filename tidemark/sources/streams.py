"""A receiver's copies of many streams in one table: rows and progress of all of them, installed in one plan.

A progress row is a stream's compare-and-swap cell: an install names the version that it was planned on, and a stream that has
moved since is refused by itself while the others are installed. Rows carry the generation that brought them; a newer tail
leaves older generations behind, a deletion leaves a fence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import STREAM_ROWS, Refusal
from tidemark.sources.commitlog import CommitLog, Snapshot

_PROGRESS = ("generation", "live_head", "lower_bound", "oldest_available", "deleted", "version")
#: How often an install is planned anew because others commit for other streams meanwhile.
TRIES = 8


class StreamsReplica:
    """Rows (``stream``, ``position``, ``record_id``, ``payload``) and progress of many streams."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.log = CommitLog(spark, path, "streams-replica", STREAM_ROWS, fold=self._folded)

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        return rows.filter("kind = 'progress'").groupBy("stream").agg(F.max_by(F.struct(*_PROGRESS), "version").alias("p")).select("stream", "p.*")

    def _folded(self, rows: DataFrame) -> DataFrame:
        """What a merge keeps: the newest progress there, and rows that it has not left behind."""
        newest = self._newest(rows).select("stream", F.col("generation").alias("__g"), F.col("deleted").alias("__d"), F.col("version").alias("__v"))
        left = (F.col("kind") == "progress") & (F.col("version") < F.col("__v")) | (F.col("kind") == "row") & (F.col("__d") | (F.col("generation") < F.col("__g")))
        return rows.join(newest, "stream", "left").filter(~F.coalesce(left, F.lit(False))).drop("__g", "__d", "__v")

    def progress(self, at: Snapshot | None = None) -> DataFrame:
        """``stream``, ``generation``, ``live_head``, ``lower_bound``, ``oldest_available``, ``deleted``, ``version``."""
        return self._newest(self.log.read(at or self.log.snapshot()))

    def rows(self, at: Snapshot | None = None) -> DataFrame:
        """The rows of every stream's generation; none of a deleted stream."""
        at = at or self.log.snapshot()
        live = self.progress(at).filter("NOT deleted").select("stream", "generation")
        return self.log.read(at).filter("kind = 'row'").join(live, ["stream", "generation"]).select("stream", "position", "record_id", "payload")

    def _install(self, plan: Callable[[Snapshot], tuple[DataFrame, DataFrame | None]]) -> DataFrame:
        """Commit what ``plan`` makes of a snapshot: told rows (``stream``, ``refusal``, progress) and new rows; returns ``stream`` and ``refusal``."""
        for _ in range(TRIES):
            at = self.log.snapshot()
            told, rows = plan(at)
            told = told.persist()
            try:
                good = told.filter("refusal IS NULL")
                if not good.isEmpty():
                    version = F.lit(at.version + 1).cast("bigint").alias("version")
                    shaped = [good.select("stream", *_PROGRESS[:-1], version, F.lit("progress").alias("kind"))]
                    if rows is not None:
                        shaped.append(rows.join(good.select("stream", "generation"), "stream").withColumn("kind", F.lit("row")))
                    full = [r.select(*[(F.col(f.name) if f.name in r.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STREAM_ROWS]) for r in shaped]
                    self.log.commit(at, at.state, full[0] if len(full) == 1 else full[0].unionByName(full[1]))
                return told.select("stream", "refusal")
            except Refusal as refusal:
                if refusal.code != "Stale":
                    raise
            finally:
                told.unpersist()
        raise Refusal("Stale", "others kept committing")

    def _expected(self, told: DataFrame, at: Snapshot) -> DataFrame:
        """What an install names beside what is saved now, with a refusal of streams that moved since."""
        saved = self.progress(at).select("stream", *[F.col(c).alias(f"s_{c}") for c in _PROGRESS])
        both = told.join(saved, "stream", "left")
        moved = F.coalesce("s_version", F.lit(0)) != F.coalesce("expected", F.lit(0))
        return both.withColumn("refusal", F.when(F.col("s_deleted"), "Deleted").when(moved, "Stale"))

    def install_tails(self, tails: DataFrame, rows: DataFrame) -> DataFrame:
        """Install the newest rows of streams under a new generation.

        ``tails``: ``stream``, ``first``, ``watermark``, ``oldest``, ``expected`` (the version of the progress that it was planned on, or null).
        """

        def plan(at: Snapshot) -> tuple[DataFrame, DataFrame]:
            both = self._expected(tails, at)
            told = both.select(
                "stream", F.coalesce("refusal", F.when(F.col("watermark") < F.col("s_live_head"), "Stale")).alias("refusal"),
                (F.coalesce("s_generation", F.lit(0)) + 1).alias("generation"), F.col("watermark").alias("live_head"), F.col("first").alias("lower_bound"),
                F.col("oldest").alias("oldest_available"), F.lit(False).alias("deleted"),
            )
            return told, rows.select("stream", "position", "record_id", "payload")

        return self._install(plan)

    def install_older(self, pages: DataFrame, rows: DataFrame) -> DataFrame:
        """Install the rows before what is loaded; what is saved already must be the same and is not written again.

        ``pages``: ``stream``, ``first``, ``last``, ``oldest``, ``expected``.
        """

        def plan(at: Snapshot) -> tuple[DataFrame, DataFrame]:
            both = self._expected(pages, at)
            saved = self.rows(at).select("stream", "position", F.col("record_id").alias("__id"), F.col("payload").alias("__b"))
            met = rows.select("stream", "position", "record_id", "payload").join(saved, ["stream", "position"], "left")
            wrong = met.filter("__id IS NOT NULL AND (record_id <> __id OR NOT payload <=> __b)").select("stream", F.lit("ConflictingRecord").alias("wrong")).distinct()
            gap = F.when(F.col("s_generation").isNull() | (F.col("last") + 1 < F.col("s_lower_bound")), "Stale")
            told = both.join(wrong, "stream", "left").select(
                "stream", F.coalesce("refusal", gap, "wrong").alias("refusal"), F.col("s_generation").alias("generation"), F.col("s_live_head").alias("live_head"),
                F.least("s_lower_bound", "first").alias("lower_bound"), F.greatest("s_oldest_available", "oldest").alias("oldest_available"), F.lit(False).alias("deleted"),
            )
            return told, met.filter("__id IS NULL").drop("__id", "__b")

        return self._install(plan)

    def fence_deletions(self, streams: DataFrame) -> DataFrame:
        """Fence streams for ever: no rows, head 0; the generation stays."""

        def plan(at: Snapshot) -> tuple[DataFrame, None]:
            saved = self.progress(at).select("stream", "generation")
            one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
            told = streams.select("stream").distinct().join(saved, "stream", "left").select(
                "stream", F.lit(None).cast("string").alias("refusal"), F.coalesce("generation", none).alias("generation"), none.alias("live_head"),
                one.alias("lower_bound"), one.alias("oldest_available"), F.lit(True).alias("deleted"),
            )
            return told, None

        return self._install(plan)
