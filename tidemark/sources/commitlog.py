"""Snapshot-pinned Parquet segments behind a compare-and-swap log.

A table is a folder with ``_meta.json`` (kind and version), ``data/`` (immutable
segments) and ``_log/`` (one JSON document for each version). A commit writes its segment first and
then creates the next log document exclusively: whoever loses the race is Stale and
has changed nothing. A reader pins a version and reads that version's segments only.

A table with a ``zone``, a long column, writes each segment in the order of that column, in files of at most ``FILE_ROWS`` rows, and
knows the range of each file, so a page or a range opens the files that it needs. Segments are merged by tiers: once ``FANIN``
of one level have come together they become one of the next, so a read opens a logarithmic number of them and a row is
rewritten as often. The owner's ``fold`` says what a merge may leave out.

On local paths the exclusive creation is the file system's; elsewhere it is Hadoop's create
without overwrite, which is atomic on HDFS. Object stores need a FileSystem that
keeps that promise.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.schema import Refusal

FORMAT_VERSION = 2
#: Rows of one file of a segment with a zone, and files above which a segment's ranges are a table and not part of the log document.
FILE_ROWS = 1 << 14
LISTED_FILES = 32
#: Segments of one level that become one of the next.
FANIN = 8
#: Every so many versions a log document lists all live segments, so that opening reads few documents.
SUMMARY_EVERY = 32


class _LocalFiles:
    def __init__(self, root: str):
        self.root = root

    def create(self, name: str, text: str) -> bool:
        """Create a file with its whole content, durably, unless it exists."""
        path = os.path.join(self.root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        with open(draft, "x") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, path)  # fails if the name is taken; readers never see half a document
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True

    def read(self, name: str) -> str | None:
        try:
            with open(os.path.join(self.root, name)) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def list(self, name: str) -> list[str]:
        try:
            return [x for x in os.listdir(os.path.join(self.root, name)) if not x.endswith(".draft")]
        except FileNotFoundError:
            return []


class _HadoopFiles:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str) -> bool:
        try:
            out = self.fs.create(self._path(name), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        return True

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def list(self, name: str) -> list[str]:
        path = self._path(name)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []


def _files(spark: SparkSession, path: str) -> "_LocalFiles | _HadoopFiles":
    """The file system on which Spark puts the data of this path, and no other: Hadoop resolves paths without a scheme, and ``file:/x``."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = fs.makeQualified(where).toUri()
    return _LocalFiles(full.getPath()) if fs.getScheme() == "file" else _HadoopFiles(spark, full.toString())


@dataclass(frozen=True)
class Snapshot:
    """One version: its live segments and the state saved with it."""

    version: int = 0
    segments: tuple[str, ...] = ()
    state: dict = field(default_factory=dict)
    #: By segment: its level and, with a zone, ``rows`` and ``files`` ([name, low, high, top, rows] each, or None for a table beside it).
    about: dict = field(default_factory=dict)


def _name(version: int) -> str:
    return f"_log/{version:020d}.json"


def latest_version(files) -> int:
    return max((int(x[:20]) for x in files.list("_log")), default=0)


def load_snapshot(files, version: int | None = None) -> Snapshot:
    """A version of the table in ``files`` (anything that can read and list them); the latest by default."""
    version = latest_version(files) if version is None else version
    documents = []
    for v in range(version, 0, -1):
        text = files.read(_name(v))
        if text is None:
            raise Refusal("Unavailable", f"version {v}")
        documents.append(json.loads(text))
        if "all" in documents[-1]:
            break
    segments: list[str] = []
    about: dict = {}
    for d in reversed(documents):
        segments = [s for s in d.get("all", segments) if s not in set(d.get("removed", []))] + (d["added"] if "all" not in d else [])
        about |= d.get("about", {})
    return Snapshot(version, tuple(segments), documents[0]["state"] if documents else {}, {s: about.get(s, {"level": 0}) for s in segments})


class CommitLog:
    """A table of immutable segments with one state document for each version.

    ``top`` names a second column whose highest value is kept for each file. Without ``fold`` a merge keeps all rows.
    """

    def __init__(
        self, spark: SparkSession, path: str, kind: str, schema: StructType, zone: str | None = None, top: str | None = None,
        fold: Callable[[DataFrame], DataFrame] | None = None, tiers: bool = True,
    ):
        self.spark, self.path, self.kind, self.schema = spark, path.rstrip("/"), kind, schema
        self.zone, self.top, self.fold, self.tiers = zone, top or zone, fold, tiers
        self.files = _files(spark, self.path)
        self.fail_next: str | None = None
        meta = self.files.read("_meta.json")
        if meta is None:
            if self.files.list("_log") or self.files.list("data"):
                raise Refusal("ForeignTable", path)
            self.files.create("_meta.json", json.dumps({"kind": kind, "version": FORMAT_VERSION}))
            meta = self.files.read("_meta.json")
        found = json.loads(meta)
        if found != {"kind": kind, "version": FORMAT_VERSION}:
            raise Refusal("ForeignTable", f"{path} is {found}")

    def latest(self) -> int:
        return latest_version(self.files)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A pinned version; the latest by default."""
        return load_snapshot(self.files, version)

    def _open(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, at: Snapshot | None = None) -> DataFrame:
        """The rows of a snapshot."""
        at = at or self.snapshot()
        return self._open([f"{self.path}/data/{s}" for s in at.segments])

    def _ranges(self, segment: str) -> DataFrame:
        return self.spark.read.schema("file string, low bigint, high bigint, top bigint, n bigint").parquet(f"{self.path}/ranges/{segment}")

    def _files(self, at: Snapshot, segment: str, after: int | None, upto: int | None, above: int, limit: int | None) -> list[tuple]:
        """(name, low, high, top, rows) of the files of a segment that meet (after, upto] and have a top value over ``above``, in order."""
        files = at.about[segment]["files"]
        if files is None:
            rows = self._ranges(segment).filter(F.col("top") > above)
            rows = rows if after is None else rows.filter(F.col("high") > after)
            rows = rows if upto is None else rows.filter(F.col("low") <= upto)
            rows = rows.orderBy("low", "file")
            return [tuple(r) for r in (rows if limit is None else rows.limit(limit)).collect()]
        met = [tuple(f) for f in files if f[3] > above and (after is None or f[2] > after) and (upto is None or f[1] <= upto)]
        return met[:limit]

    def between(self, at: Snapshot, after: int, upto: int) -> DataFrame:
        """The rows of a snapshot whose zone is in (after, upto], from the files that may have any."""
        paths = [f"{self.path}/data/{s}/{f[0]}" for s in at.segments for f in self._files(at, s, after, upto, -(1 << 63), None)]
        return self._open(paths).filter((F.col(self.zone) > after) & (F.col(self.zone) <= upto))

    def onward(self, at: Snapshot, after: int, rows: int, above: int = -(1 << 63)) -> tuple[DataFrame, int | None, int]:
        """The rows next after ``after``: all of them up to a bound, at least ``rows`` unless they end before; the bound (None: no more follow), and how many files they are in.

        Files whose ``top`` is not over ``above`` are left out.
        """
        paths, bound = [], None
        for s in at.segments:
            # Of each segment enough files for that many rows; the first may lie partly before, and one more tells whether others follow.
            take = -(-rows // FILE_ROWS) + 1
            found = self._files(at, s, after, None, above, take + 1)
            paths += [(f[1], f"{self.path}/data/{s}/{f[0]}") for f in found[:take]]
            if len(found) > take:
                bound = found[take - 1][2] if bound is None else min(bound, found[take - 1][2])
        paths = [p for low, p in paths if bound is None or low <= bound]
        kept = self._open(paths).filter(F.col(self.zone) > after)
        return (kept if bound is None else kept.filter(F.col(self.zone) <= bound)), bound, len(paths)

    def _write(self, rows: DataFrame, name: str, level: int, few: bool = False) -> dict:
        """Write a segment; returns what the log says about it."""
        rows = rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in self.schema])
        path = f"{self.path}/data/{name}"
        if self.zone is None:
            rows.write.parquet(path)
            return {"level": level}
        dealt = rows.coalesce(1) if few else rows.repartitionByRange(self.zone)
        dealt.sortWithinPartitions(self.zone).write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
        seen = self.spark.read.schema(self.schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("file"))
        ranges = seen.agg(F.min(self.zone).alias("low"), F.max(self.zone).alias("high"), F.max(self.top).alias("top"), F.count("*").alias("n")).orderBy("low", "file")
        first = [list(r) for r in ranges.limit(LISTED_FILES + 1).collect()]
        if len(first) <= LISTED_FILES:
            return {"level": level, "rows": sum(f[4] for f in first), "files": first}
        ranges.coalesce(1).write.parquet(f"{self.path}/ranges/{name}")
        return {"level": level, "rows": self._ranges(name).agg(F.sum("n")).first()[0], "files": None}

    def commit(self, expected: Snapshot, state: dict, rows: DataFrame | None = None, replace: bool = False, few: bool = False) -> Snapshot:
        """Save rows and state as the version after ``expected``, or refuse as Stale.

        A failure after the segment is written leaves an unreferenced folder, never a half commit. ``few``: the rows are a page at most.
        """
        added, about = [], {}
        if rows is not None:
            added = [f"part-{uuid.uuid4().hex}"]
            about[added[0]] = self._write(rows, added[0], 0, few)
        fault, self.fail_next = self.fail_next, None
        if fault == "Failed":
            raise Refusal("Failed", "injected before the commit")
        done = self._save(expected, state, added, about, list(expected.segments) if replace else [])
        if fault == "Uncertain":
            raise Refusal("Uncertain", "injected after the commit")
        return self._settle(done) if added and self.tiers else done

    def _save(self, expected: Snapshot, state: dict, added: list[str], about: dict, removed: list[str]) -> Snapshot:
        live = [s for s in expected.segments if s not in set(removed)] + added
        known = expected.about | about
        version = expected.version + 1
        document: dict = {"version": version, "added": added, "removed": removed, "state": state, "about": about}
        if len(removed) == len(expected.segments) or version % SUMMARY_EVERY == 0:
            document |= {"all": live, "removed": [], "about": {s: known[s] for s in live}}
        if not self.files.create(_name(version), json.dumps(document)):
            raise Refusal("Stale", f"version {version} is taken")
        return Snapshot(version, tuple(live), state, {s: known[s] for s in live})

    def _settle(self, at: Snapshot) -> Snapshot:
        """Merge tiers that are full. Another writer's commit meanwhile is no fault: the next one tries again."""
        while True:
            levels: dict[int, list[str]] = {}
            for s in at.segments:
                levels.setdefault(at.about[s]["level"], []).append(s)
            full = next((lv for lv in sorted(levels) if len(levels[lv]) >= FANIN), None)
            if full is None:
                return at
            rows = self._open([f"{self.path}/data/{s}" for s in levels[full]])
            name = f"part-{uuid.uuid4().hex}"
            about = self._write(self.fold(rows) if self.fold else rows, name, full + 1)
            try:
                at = self._save(at, at.state, [name], {name: about}, levels[full])
            except Refusal:
                return at

    def compact(self, expected: Snapshot, rows: DataFrame | None = None) -> Snapshot:
        """Rewrite the live segments as one; the content is that of ``rows`` or of the snapshot."""
        level = 1 + max((expected.about[s]["level"] for s in expected.segments), default=0)
        name = f"part-{uuid.uuid4().hex}"
        about = self._write(self.read(expected) if rows is None else rows, name, level)
        return self._save(expected, expected.state, [name], {name: about}, list(expected.segments))
