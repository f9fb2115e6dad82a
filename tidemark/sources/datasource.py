"""Record and catalogue tables as data sources of Spark, for batch reads and for streams.

``register(spark)`` makes two formats known. ``tidemark_records`` has the readable records of a source by position, ``tidemark_catalogue`` the
saved states of entries by revision. A reader pins one version of the table, takes the files whose range meets what is asked for,
and deals them out in groups; tasks read them with Arrow. Comparisons with the position (revision) in a filter choose files and are not
evaluated again. The offset of a stream is the position (revision) up to which it has come, so a batch is what was committed since the one
before, and it may be planned again, from any later version, with the same result.

Options: ``path``; ``after`` and ``upto`` bound the range; ``version`` pins a version (batch); ``columns`` (names with commas) reads
those only; ``filesPerPartition`` is the size of a group.

Edges: an empty or unborn table has no rows; a path of another kind is a ForeignTable; a start below the floor of a source, or a stream that
falls behind it, is Pruned; a table whose head is behind the offset of a stream was exchanged: ResetRequired. A merge may have left out states of
an entry that later ones supersede, so a catalogue stream hands on the latest state by the time it is read and not each that ever was; a
retired entry comes as a deleted state with ``retired`` set. Hiding and retiring a marker is no revision, hence no change to a stream that has it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BooleanType, StructField, StructType

from tidemark.schema import ENTRIES, RECORDS, Refusal
from tidemark.sources.commitlog import FORMAT_VERSION, Snapshot, _files, load_snapshot

LEAST, MOST = -(1 << 63), (1 << 63) - 1
FILES_PER_PARTITION = 8


class _ArrowFiles:
    """The files of a table as a Python worker reads them, without a session."""

    def __init__(self, root: str):
        if root.startswith("file:"):
            root = "/" + root.removeprefix("file:").lstrip("/")
        try:
            self.fs, self.root = fs.FileSystem.from_uri(root)
        except (ValueError, pa.ArrowInvalid) as e:
            raise Refusal("InvalidRequest", f"{root} is neither an absolute path nor a URI") from e

    def read(self, name: str) -> str | None:
        try:
            with self.fs.open_input_stream(f"{self.root}/{name}") as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def list(self, name: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{name}", allow_not_found=True))
        return [x.base_name for x in found if not x.base_name.endswith(".draft")]

    def rows(self, name: str) -> list[dict]:
        """The rows of a small Parquet folder."""
        return pq.read_table(f"{self.root}/{name}", filesystem=self.fs, use_threads=False).to_pylist()


class _Files(InputPartition):
    """Files of a table, of which a task hands on the rows in (after, upto]."""

    def __init__(self, root: str, names: list[str], after: int, upto: int):
        self.root, self.names, self.after, self.upto = root, names, after, upto


class _Table:
    """What both readers share: the pinned version and the files of a range."""

    def __init__(self, kind: str, by: str, floor: str | None, schema: StructType, options: dict):
        self.kind, self.by, self.floor_name, self.names = kind, by, floor, schema.fieldNames()
        self.root = options["path"].rstrip("/")
        self.group = int(options.get("filesPerPartition", FILES_PER_PARTITION))
        if self.group < 1:
            raise Refusal("InvalidLimits", "filesPerPartition")

    def at(self, version: int | None = None) -> Snapshot:
        files = _ArrowFiles(self.root)
        meta = files.read("_meta.json")
        if meta is None:
            raise Refusal("Unavailable", self.root)
        if json.loads(meta) != {"kind": self.kind, "version": FORMAT_VERSION}:
            raise Refusal("ForeignTable", f"{self.root} is {meta}")
        return load_snapshot(files, version)

    def floor(self, at: Snapshot) -> int:
        return at.state.get(self.floor_name, 0) if self.floor_name else 0

    def plan(self, at: Snapshot, after: int, upto: int) -> list[_Files]:
        """The files that may have rows in (after, upto], in groups, in the order of their ranges."""
        store, met = _ArrowFiles(self.root), []
        for segment in at.segments:
            told = at.about[segment]["files"]
            if told is None:
                told = [[r["file"], r["low"], r["high"], r["top"], r["n"]] for r in store.rows(f"ranges/{segment}")]
            # The low end of a file is of its order; only where that is the column asked for does it close the range.
            met += [(low, f"{segment}/{name}") for name, low, _, top, _ in told if top > after and (self.by != "position" or low <= upto)]
        names = [name for _, name in sorted(met)]
        return [_Files(self.root, names[i : i + self.group], after, upto) for i in range(0, len(names), self.group)]

    def batches(self, part: _Files | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark makes one empty partition where there are none
            return
        store = _ArrowFiles(part.root)
        read = self.names if self.by in self.names else [*self.names, self.by]
        for name in part.names:
            with store.fs.open_input_file(f"{store.root}/data/{name}") as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=4096, columns=read, use_threads=False):
                    at = batch.column(self.by)
                    kept = batch.filter(pc.and_(pc.greater(at, part.after), pc.less_equal(at, part.upto)))
                    if kept.num_rows:
                        # Files differ in what they say of nulls and in metadata; batches of one stream may not.
                        yield pa.RecordBatch.from_arrays([kept.column(n) for n in self.names], names=self.names)


class _Reader(DataSourceReader):
    def __init__(self, table: _Table, options: dict):
        self.table = table
        self.after, self.upto = int(options.get("after", LEAST)), int(options.get("upto", MOST))
        self.version = int(options["version"]) if "version" in options else None
        self.asked = "after" in options

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != (self.table.by,):
                yield f
            elif isinstance(f, GreaterThan):
                self.after = max(self.after, f.value)
            elif isinstance(f, GreaterThanOrEqual):
                self.after = max(self.after, f.value - 1) if f.value > LEAST else self.after
            elif isinstance(f, LessThan):
                self.upto = min(self.upto, f.value - 1) if f.value > LEAST else LEAST
            elif isinstance(f, LessThanOrEqual):
                self.upto = min(self.upto, f.value)
            elif isinstance(f, EqualTo):
                self.after, self.upto = (max(self.after, f.value - 1) if f.value > LEAST else self.after), min(self.upto, f.value)
            elif not isinstance(f, IsNotNull):  # never null
                yield f

    def partitions(self) -> list[_Files]:
        at = self.table.at(self.version)
        floor = self.table.floor(at)
        if self.asked and self.after < floor:
            raise Refusal("Pruned", f"{self.after} is below the floor {floor}")
        after = max(self.after, floor)
        return self.table.plan(at, after, self.upto) if after < self.upto else []

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        return self.table.batches(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, table: _Table, options: dict):
        self.table, self.after = table, options.get("after")

    def initialOffset(self) -> dict:
        return {self.table.by: self.table.floor(self.table.at()) if self.after is None else int(self.after)}

    def latestOffset(self) -> dict:
        at = self.table.at()
        return {self.table.by: max(at.state.get("head", 0), self.table.floor(at))}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        at, after, upto = self.table.at(), start[self.table.by], end[self.table.by]
        if upto > max(at.state.get("head", 0), self.table.floor(at)) or upto < after:
            raise Refusal("ResetRequired", f"the table ends before {max(after, upto)}")
        if after < self.table.floor(at):
            raise Refusal("Pruned", f"{after} is below the floor {self.table.floor(at)}")
        return self.table.plan(at, after, upto)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        return self.table.batches(partition)


class _TableSource(DataSource):
    KIND = BY = ""
    FLOOR: str | None = None
    SCHEMA = StructType()

    def schema(self) -> StructType:
        names = self.options.get("columns")
        if names is None:
            return self.SCHEMA
        wanted = [n.strip() for n in names.split(",")]
        if not set(wanted) <= set(self.SCHEMA.fieldNames()):
            raise Refusal("InvalidRequest", f"columns are {', '.join(self.SCHEMA.fieldNames())}")
        return StructType([self.SCHEMA[n] for n in wanted])

    def _table(self, schema: StructType) -> _Table:
        return _Table(self.KIND, self.BY, self.FLOOR, schema, self.options)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self._table(schema), self.options)

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self._table(schema), self.options)


class RecordSource(_TableSource):
    KIND, BY, FLOOR, SCHEMA = "record-source", "position", "floor", RECORDS

    @classmethod
    def name(cls) -> str:
        return "tidemark_records"


class CatalogueSource(_TableSource):
    KIND, BY, SCHEMA = "catalogue-source", "revision", StructType([*ENTRIES.fields, StructField("retired", BooleanType(), False)])

    @classmethod
    def name(cls) -> str:
        return "tidemark_catalogue"


FORMATS = {c.KIND: c.name() for c in (RecordSource, CatalogueSource)}


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (RecordSource, CatalogueSource):
        spark.dataSource.register(source)


def _located(spark: SparkSession, path: str) -> str:
    """The path as the session resolves it; a worker knows of no default file system."""
    return _files(spark, path).root


def read_table(spark: SparkSession, kind: str, path: str, **options: str | int) -> DataFrame:
    """A table as a batch; ``kind`` is that of its log."""
    register(spark)
    return spark.read.format(FORMATS[kind]).options(**options).load(_located(spark, path))


def stream_table(spark: SparkSession, kind: str, path: str, **options: str | int) -> DataFrame:
    """A table as a stream from ``after`` on (its floor by default)."""
    register(spark)
    return spark.readStream.format(FORMATS[kind]).options(**options).load(_located(spark, path))
