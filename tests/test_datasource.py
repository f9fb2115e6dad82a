"""Tables as data sources: ranges, pinned versions, streams, refusals."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual, StringContains

from tidemark.schema import RECORDS, Refusal, Scope
from tidemark.sources import commitlog
from tidemark.sources.commitlog import CommitLog
from tidemark.sources.datasource import CatalogueSource, RecordSource, read_table, register, stream_table
from tidemark.sources.tables import CatalogueTable, RecordTable
from tidemark.streaming.follow import follow_table

SCOPE = Scope("r", "o", "s", "i", "v1", "e1")


def _records(spark, low, high):
    return spark.range(low, high + 1).select(F.col("id").alias("seq"), F.concat(F.lit("r"), "id").alias("record_id"), F.concat(F.lit("p"), "id").cast("binary").alias("payload"))


def _reader(path, **options):
    source = RecordSource({"path": path, **options})
    return source.reader(source.schema())


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Three commits in files of 16 rows; the first has its ranges in a table beside it."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(commitlog, "FILE_ROWS", 16)
        made = RecordTable(spark, str(tmp_path_factory.mktemp("source") / "t"), SCOPE)
        for low, high in ((1, 800), (801, 900), (901, 1000)):
            made.append(_records(spark, low, high))
    assert [made.log.snapshot().about[s]["files"] is None for s in made.log.snapshot().segments] == [True, False, False]
    return made


def _positions(df):
    return sorted(r["position"] for r in df.select("position").collect())


def test_whole_table_and_columns(spark, table):
    rows = read_table(spark, table.log.kind, table.log.path)
    assert sorted(rows.collect()) == sorted(table.log.read().collect())
    ids = read_table(spark, table.log.kind, "file:" + table.log.path, columns="record_id")
    assert ids.columns == ["record_id"] and ids.distinct().count() == 1000


@pytest.mark.parametrize("rule,want", [
    ("position > 100 AND position <= 120", range(101, 121)), ("position = 500", [500]), ("position >= 999", [999, 1000]), ("position < 3", [1, 2]),
    ("position > 990 AND record_id LIKE '%5'", [995]), ("position > 1000", []), ("position > 5 AND position < 5", []), ("position IN (3, 900)", [3, 900]),
])
def test_filters(spark, table, rule, want):
    assert _positions(read_table(spark, table.log.kind, table.log.path).filter(rule)) == list(want)


def test_filters_choose_files(table):
    reader = _reader(table.log.path, filesPerPartition="1")
    whole = len(reader.partitions())
    assert whole >= 1000 // 16
    name = StringContains(("record_id",), "5")
    assert list(reader.pushFilters([GreaterThan(("position",), 100), name, LessThanOrEqual(("position",), 120)])) == [name]
    assert sum(len(p.names) for p in reader.partitions()) <= 3
    one = _reader(table.log.path)
    assert list(one.pushFilters([EqualTo(("position",), 850)])) == [] and [len(p.names) for p in one.partitions()] == [1]
    assert max(len(p.names) for p in _reader(table.log.path).partitions()) == 8


def test_pinned_version(spark, table):
    assert _positions(read_table(spark, table.log.kind, table.log.path, version=2)) == list(range(1, 901))


def test_refusals(spark, table, tmp_path):
    for make, code in (
        (lambda: CatalogueSource({"path": table.log.path}).reader(RECORDS).partitions(), "ForeignTable"),
        (lambda: _reader(str(tmp_path / "none")).partitions(), "Unavailable"),
        (lambda: _reader("relative/path").partitions(), "InvalidRequest"),
        (lambda: RecordSource({"path": "/x", "columns": "position,other"}).schema(), "InvalidRequest"),
        (lambda: _reader(table.log.path, filesPerPartition="0"), "InvalidLimits"),
        (lambda: _reader(table.log.path, version="9").partitions(), "Unavailable"),
    ):
        with pytest.raises(Refusal) as refused:
            make()
        assert refused.value.code == code


def test_floor(spark, tmp_path):
    source = RecordTable(spark, str(tmp_path / "t"), SCOPE)
    assert _positions(read_table(spark, source.log.kind, source.log.path)) == []
    source.append(_records(spark, 1, 50))
    source.prune_through(20)
    assert _positions(read_table(spark, source.log.kind, source.log.path)) == list(range(21, 51))
    with pytest.raises(Refusal, match="Pruned"):
        _reader(source.log.path, after="19").partitions()
    stream = RecordSource({"path": source.log.path}).streamReader(RECORDS)
    assert (stream.initialOffset(), stream.latestOffset()) == ({"position": 20}, {"position": 50})
    with pytest.raises(Refusal, match="Pruned"):
        stream.partitions({"position": 10}, {"position": 50})
    with pytest.raises(Refusal, match="ResetRequired"):
        stream.partitions({"position": 50}, {"position": 60})


def test_a_batch_planned_again_is_the_same(table):
    """Offsets of an earlier version, planned from a later one."""
    stream = RecordSource({"path": table.log.path}).streamReader(RECORDS)
    parts = stream.partitions({"position": 790}, {"position": 905})
    assert sorted(p for part in parts for b in stream.read(part) for p in b.column("position").to_pylist()) == list(range(791, 906))


def test_follow_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commitlog, "FANIN", 2)  # segments are merged between the runs
    source = RecordTable(spark, str(tmp_path / "t"), SCOPE)
    copy, added = CommitLog(spark, str(tmp_path / "copy"), "record-copy", RECORDS, zone="position"), []
    for high in (0, 40, 70, 70, 200):
        if high > source.log.snapshot().state.get("head", 0):
            source.append(_records(spark, source.log.snapshot().state.get("head", 0) + 1, high))
        added.append(follow_table(spark, source.log.kind, source.log.path, copy, str(tmp_path / "progress")))
    assert added[1:] == [1, 1, 0, 1]
    assert sorted(copy.read().collect()) == sorted(source.log.read().collect())


def test_running_stream(spark, table, tmp_path):
    """By format name, from a position on, joined to nothing but Spark's own sink."""
    register(spark)
    rows = stream_table(spark, table.log.kind, table.log.path, after=600)
    query = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert _positions(spark.read.parquet(str(tmp_path / "out"))) == list(range(601, 1001))


def test_catalogue_by_revision(spark, tmp_path):
    """Deleted, hidden and retired entries reach a copy as deleted; a later value replaces an earlier one."""
    source = CatalogueTable(spark, str(tmp_path / "t"), SCOPE)
    copy = CommitLog(spark, str(tmp_path / "copy"), "catalogue-copy", source.log.schema, zone="creation", top="revision", fold=source.log.fold)
    schema = "seq bigint, entry_id string, is_del boolean, payload binary"
    batches = ([(1, "a", False, b"1"), (2, "b", False, b"2"), (3, "c", False, b"3")], [(4, "a", True, None), (5, "b", False, b"5")], [(6, "d", False, None), (7, "c", True, None)])
    for k, rows in enumerate(batches):
        source.apply(spark.createDataFrame(rows, schema))
        if k != 1:  # one run sees two commits
            follow_table(spark, source.log.kind, source.log.path, copy, str(tmp_path / "progress"))
    got = {r["entry_id"]: (r["deleted"], r["payload"], r["revision"]) for r in copy.fold(copy.read()).collect()}
    assert got == {r["entry_id"]: (r["deleted"], r["payload"], r["revision"]) for r in source.entries().collect()}
    assert _changed(spark, source, 3) == {"a", "b", "c", "d"} and _changed(spark, source, 99) == set()
    source.collect(7)
    source.compact_all_retired()
    fresh = read_table(spark, source.log.kind, source.log.path).groupBy("entry_id").agg(F.max_by("deleted", F.struct("revision", "retired")).alias("deleted"))
    assert {r["entry_id"]: r["deleted"] for r in fresh.collect()} == {"a": True, "b": False, "c": True, "d": False}


def _changed(spark, source, revision):
    rows = read_table(spark, source.log.kind, source.log.path).filter(F.col("revision") > revision)
    return {r["entry_id"] for r in rows.collect()}
