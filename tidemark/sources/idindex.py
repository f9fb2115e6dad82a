"""An index of record ids: which are known, with which bytes, at which position.

Runs of (record_id, digest, position) are dealt into folders by the first bits of the id's hash, about ``BUCKET_ROWS`` rows each, with
Parquet's Bloom filters on the id. A batch of a few records opens only the buckets that its ids fall into, and a few ids reach the
scan as a filter that the Bloom filters answer; so what an append reads does not grow with the table. The list of runs is part of
the state that a commit saves, so index and table move together. Runs of one level are merged as those of the table are.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.commitlog import FANIN, CommitLog

BUCKET_ROWS = 1 << 14
#: Buckets up to which a batch names the folders that it opens, and ids up to which it names the ids.
NAMED_BUCKETS, NAMED_IDS = 128, 32
MAX_BITS = 20
_SCHEMA = "record_id string, digest binary, position bigint"


def _bucket(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("record_id"), 64 - bits) if bits else F.lit(0).cast("bigint")


def digest(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


class IdIndex:
    """The runs named in a state, below the folder of a log."""

    def __init__(self, log: CommitLog, runs: list[dict]):
        self.log, self.runs = log, runs

    @property
    def spark(self) -> SparkSession:
        return self.log.spark

    def _path(self, run: dict) -> str:
        return f"{self.log.path}/ids/{run['name']}"

    def _read(self, runs: list[dict], buckets: dict[str, list[int]] | None) -> DataFrame:
        """Runs, or the named buckets of each, in one scan: a union of scans would be joined run by run."""
        if buckets is None:
            paths = [self._path(r) for r in runs]
        else:
            paths = [f"{self._path(r)}/bucket={b}" for r in runs for b in buckets[r["name"]] if self.log.files.list(f"ids/{r['name']}/bucket={b}")]
        reader = self.spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true")
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)

    def lookup(self, ids: DataFrame) -> DataFrame:
        """What is known of the ids of a batch (``record_id``)."""
        if not self.runs:
            return self.spark.createDataFrame([], _SCHEMA)
        bits = max(r["bits"] for r in self.runs)
        met = [r["b"] for r in ids.select(_bucket(bits).alias("b")).distinct().limit(NAMED_BUCKETS + 1).collect()]
        few = len(met) <= NAMED_BUCKETS
        rows = self._read(self.runs, {r["name"]: sorted({b >> bits - r["bits"] for b in met}) for r in self.runs} if few else None)
        named = [r["record_id"] for r in ids.select("record_id").limit(NAMED_IDS + 1).collect()] if few else []
        if few and len(named) <= NAMED_IDS:
            return rows.filter(functools.reduce(Column.__or__, [F.col("record_id") == i for i in named], F.lit(False)))
        return rows.join(ids.select("record_id").distinct(), "record_id", "left_semi")

    def _write(self, rows: DataFrame, count: int, level: int) -> dict:
        bits = min(MAX_BITS, max(0, (max(count, 1) // BUCKET_ROWS).bit_length()))
        run = {"name": f"run-{uuid.uuid4().hex}", "level": level, "bits": bits, "rows": count}
        dealt = rows.select("record_id", "digest", "position", _bucket(bits).alias("bucket"))
        dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "record_id") if bits else dealt.coalesce(1).sortWithinPartitions("record_id")
        dealt.write.option("parquet.bloom.filter.enabled#record_id", "true").option("parquet.bloom.filter.expected.ndv#record_id", str(2 * BUCKET_ROWS)).partitionBy("bucket").parquet(self._path(run))
        return run

    def added(self, rows: DataFrame, count: int) -> list[dict]:
        """The runs once ``count`` rows (``record_id``, ``payload``, ``position``) have been added; full levels are merged."""
        if not count:
            return self.runs
        runs = [*self.runs, self._write(rows.withColumn("digest", digest(F.col("payload"))), count, 0)]
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= FANIN:
            merged = self._read(full, None)
            runs = [r for r in runs if r["level"] != level] + [self._write(merged, sum(r["rows"] for r in full), level + 1)]
            level += 1
        return runs
