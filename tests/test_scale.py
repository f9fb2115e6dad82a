"""What reads and writes touch as tables grow, ordered admission, keyed streams, and where tables and the package lie."""

import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from tidemark import shipping
from tidemark.plans import passes
from tidemark.schema import ENTRIES, RECORDS, Limits, PageRequest, Refusal, Scope
from tidemark.sources import commitlog, idindex
from tidemark.sources.commitlog import CommitLog
from tidemark.sources.idindex import IdIndex
from tidemark.sources.memory import MemoryAuthorizer
from tidemark.sources.tables import CatalogueTable, RecordTable, ReplicaTable
from tidemark.streaming.follow import fold, follow_hints

SCOPE = Scope("device-a", "origin", "transcript", "first", "text-v1", "epoch-1")
ALLOW = MemoryAuthorizer()
MUTATIONS = "seq bigint, entry_id string, is_del boolean, payload binary"


def _facts(spark, first, last):
    return spark.createDataFrame([(i, f"fact-{i}", bytearray(f"message-{i}".encode())) for i in range(first, last + 1)], "seq bigint, record_id string, payload binary")


def _mutations(spark, rows):
    return spark.createDataFrame([(s, k, d, None if d or d is None else bytearray(p)) for s, k, d, p in rows], MUTATIONS)


def refused(code, call, *args, **kwargs):
    with pytest.raises(Refusal) as e:
        call(*args, **kwargs)
    assert e.value.code == code


def _cache(spark, path):
    return passes.CatalogueCache(CommitLog(spark, path, "catalogue-cache", ENTRIES))


# --- where tables and the package lie ---------------------------------------------

@pytest.mark.parametrize("form", ["file:{}", "file://{}", "{}"])
def test_log_and_data_lie_together(spark, tmp_path, form):
    log = CommitLog(spark, form.format(tmp_path / "t"), "k", RECORDS)
    log.commit(log.snapshot(), {"n": 1}, spark.createDataFrame([(1, "a", bytearray(b"x"))], RECORDS))
    assert sorted(os.listdir(tmp_path / "t")) == ["_log", "_meta.json", "data"] and log.read().count() == 1
    assert CommitLog(spark, str(tmp_path / "t"), "k", RECORDS).snapshot().state == {"n": 1}


def test_the_shipped_archive_has_everything(tmp_path):
    archive = shipping.archive(str(tmp_path / "package.zip"))
    code = f"import sys; sys.path.insert(0, {archive!r}); import tidemark.catalog, importlib.util as u; assert tidemark.__file__.startswith({archive!r})\nif u.find_spec('tidemark.llm'): import tidemark.llm.queries"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


# --- zones and tiers ----------------------------------------------------------------

def test_pages_open_files_of_their_own_range(spark, tmp_path, monkeypatch):
    """Of a table four times as large a page opens no more files, and a row count is read for none of the others."""
    monkeypatch.setattr(commitlog, "FILE_ROWS", 16)
    opened = {}
    for n in (200, 800):
        source = CatalogueTable(spark, f"{tmp_path}/c{n}", SCOPE)
        source.apply(_mutations(spark, [(i, f"item-{i:05}", False, b"live") for i in range(n)]))
        at, cursor, opened[n], seen = source.snapshot(), None, [], []
        while True:
            found, files = source.manifest_page(n, 0, cursor, 20, at)
            opened[n].append(files)
            seen += [r["entry_id"] for r in found[:20]]
            if len(found) <= 20:
                break
            cursor = (found[19]["creation"], found[19]["entry_id"])
        assert seen == [f"item-{i:05}" for i in range(n)]
        values, proofs = source.states(100, 110, at)
        assert values.count() == 11 and len(values.inputFiles()) <= 2 and proofs.count() == 0
    assert max(opened[800]) <= max(opened[200]) <= 4
    # A pass for two late changes passes over files in which nothing has changed.
    source.apply(_mutations(spark, [(1000, "item-00003", False, b"new"), (1001, "item-00700", True, b"")]))
    found, files = source.manifest_page(802, 800, None, 20)
    assert [(r["entry_id"], r["revision"], r["deleted"]) for r in found] == [("item-00003", 801, False), ("item-00700", 802, True)] and files <= 4


@pytest.mark.parametrize("listed", [32, 1])
def test_ranges_of_large_segments_are_a_table(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(commitlog, "FILE_ROWS", 10)
    monkeypatch.setattr(commitlog, "LISTED_FILES", listed)
    log = CommitLog(spark, f"{tmp_path}/t", "k", RECORDS, zone="position")
    rows = _facts(spark, 1, 95).select(F.col("seq").alias("position"), "record_id", "payload")
    at = log.commit(log.snapshot(), {}, rows)
    at = log.commit(at, {}, rows.withColumn("position", F.col("position") + 95))
    assert sorted(r["position"] for r in log.between(at, 90, 101).collect()) == list(range(91, 102))
    assert len(log.between(at, 90, 101).inputFiles()) <= 4
    after, got = 0, []
    while after is not None:
        part, after, files = log.onward(at, after, 15)
        got += sorted(r["position"] for r in part.collect())
        assert files <= 6
    assert got == list(range(1, 191))


def test_tiers_keep_segments_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commitlog, "FANIN", 2)
    table = RecordTable(spark, f"{tmp_path}/t", SCOPE)
    for i in range(6):
        table.append(_facts(spark, 2 * i, 2 * i + 1))
    assert len(table.log.snapshot().segments) == 2 and table.log.read().count() == 12  # four and two
    page = table.page(PageRequest(SCOPE, 5, 12, Limits(5, 10_000, 500)))
    assert sorted(r["position"] for r in page.collect()) == list(range(6, 11))
    source = CatalogueTable(spark, f"{tmp_path}/c", SCOPE)
    for i in range(4):
        source.apply(_mutations(spark, [(3 * i, "same", False, b"%d" % i), (3 * i + 1, f"own-{i}", False, b"x"), (3 * i + 2, f"own-{i}", True, b"")]))
    rows = {r["entry_id"]: (r["creation"], r["revision"], r["deleted"]) for r in source.entries().collect()}
    assert rows == {"same": (1, 10, False)} | {f"own-{i}": (3 * i + 2, 3 * i + 3, True) for i in range(4)}
    assert len(source.log.snapshot().segments) == 1 and source.log.read().count() == 5  # the merges kept the latest states


# --- the index of ids ------------------------------------------------------------------

def test_an_append_reads_the_buckets_that_it_meets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idindex, "BUCKET_ROWS", 64)
    size = {}
    for n in (1000, 8000):
        table = RecordTable(spark, f"{tmp_path}/t{n}", SCOPE)
        table.append(_facts(spark, 1, n))
        index = IdIndex(table.log, table.log.snapshot().state["ids"])
        batch = _facts(spark, 5, 7).unionByName(_facts(spark, n + 1, n + 2))
        known = index.lookup(batch)
        assert {(r["record_id"], r["position"]) for r in known.collect()} == {(f"fact-{i}", i) for i in (5, 6, 7)}
        size[n] = sum(os.path.getsize(f.removeprefix("file://")) for f in known.inputFiles())
        assert table.append(batch) == n + 2
        refused("ConflictingRecord", table.append, _facts(spark, 9, 9).withColumn("payload", F.lit(b"other")))
        assert table.append(_facts(spark, 1, n + 2)) == n + 2  # a batch that meets all buckets reads all
    assert 0 < size[8000] < 2 * size[1000]


def test_replicas_know_ids_by_the_index(spark, tmp_path):
    store = ReplicaTable(spark, f"{tmp_path}/r")
    rows = _facts(spark, 1, 6).withColumnRenamed("seq", "position")
    assert store.apply(SCOPE, 0, rows.filter("position <= 3")) == 3
    moved = rows.filter("position = 2").withColumn("position", F.lit(4).cast("bigint"))
    refused("ConflictingRecord", store.apply, SCOPE, 3, moved)
    assert store.apply(SCOPE, 3, rows.filter("position > 3")) == 6 and store.apply(SCOPE, 0, rows) == 6


# --- ordered admission -------------------------------------------------------------------

def test_late_and_tied_mutations_change_nothing(spark, tmp_path):
    table = CatalogueTable(spark, f"{tmp_path}/c", SCOPE)
    table.apply(_mutations(spark, [(10, "a", False, b"new")]))
    refused("Stale", table.apply, _mutations(spark, [(1, "a", False, b"old")]))
    refused("Stale", table.apply, _mutations(spark, [(10, "a", False, b"again"), (11, "b", False, b"x")]))
    refused("InvalidPlan", table.apply, _mutations(spark, [(20, k, False, b"tied") for k in "abc"]))
    refused("InvalidPlan", table.apply, _mutations(spark, [(None, "a", False, b"x")]))
    assert table.head() == 1 and [bytes(r["payload"]) for r in table.entries().collect()] == [b"new"]
    table.apply(_mutations(spark, [(30, "a", False, b"new")]))  # quiet, but passed
    refused("Stale", table.apply, _mutations(spark, [(30, "a", False, b"other")]))


def _arrive(spark, rows, folder):
    rows.coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)


def test_a_stream_out_of_order_equals_the_fold_in_order(spark, tmp_path):
    files = [
        [(10, "a", False, b"old"), (12, "b", False, b"b1"), (0, "z", False, b"zero")],
        [(11, "a", False, b"new"), (5, "a", False, b"first"), (14, "b", True, b""), (12, "b", False, b"b1")],
        [(13, "b", False, b"b2"), (15, "b", False, b"back"), (12, "b", False, b"other"), (40, None, None, None)],
        [(6, "a", False, b"late"), (60, None, None, None)],
    ]
    for rows in files:
        _arrive(spark, _mutations(spark, rows), f"{tmp_path}/in")
    table = CatalogueTable(spark, f"{tmp_path}/c", SCOPE)
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    for _ in range(2):
        assert fold(spark, f"{tmp_path}/in", schema, table, f"{tmp_path}/progress", 10, max_files=1, refused=f"{tmp_path}/refused") == 7
    plain = CatalogueTable(spark, f"{tmp_path}/p", SCOPE)
    plain.apply(_mutations(spark, [(0, "z", False, b"zero"), (5, "a", False, b"first"), (10, "a", False, b"old"), (11, "a", False, b"new"), (12, "b", False, b"b1"), (13, "b", False, b"b2"), (14, "b", True, b""), (15, "b", False, b"back")]))
    assert sorted(map(str, table.entries().collect())) == sorted(map(str, plain.entries().collect()))
    assert {(r["seq"], r["entry_id"], r["refusal"]) for r in spark.read.parquet(f"{tmp_path}/refused").collect()} == {(6, "a", "Stale"), (12, "b", "InvalidPlan")}


def test_hints_that_are_no_news_and_late_ones_are_dropped(spark, tmp_path):
    rows = lambda x: spark.createDataFrame(x, "stream string, head bigint, at string").withColumn("at", F.to_timestamp("at"))
    day = lambda d, h="10": f"2024-01-{d:02} {h}:00:00"
    for part in ([("a", 5, day(1)), ("a", 7, day(1, "11")), ("b", 3, day(2))], [("a", 6, day(3)), ("b", 4, day(3))], [("a", 99, day(1)), ("a", 8, day(5)), ("b", 1, day(9))]):
        _arrive(spark, rows(part), f"{tmp_path}/in")
    follow_hints(spark, f"{tmp_path}/in", rows([]).schema, f"{tmp_path}/out", f"{tmp_path}/progress", "stream", "head", "at", "1 day", "1 hour", max_files=1)
    got = {(r["stream"], r["opened"].day, r["head"], r["hints"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 1, 7, 2), ("b", 2, 3, 1), ("b", 3, 4, 1), ("a", 5, 8, 1)}


# --- markers and recovery --------------------------------------------------------------------

def test_hidden_markers_are_consumed_from_their_lists(spark, tmp_path, monkeypatch):
    source = CatalogueTable(spark, f"{tmp_path}/c", SCOPE)
    source.apply(_mutations(spark, [(i, f"i{i}", False, b"x") for i in range(9)] + [(10 + i, f"i{i}", True, b"") for i in range(7)]))
    assert source.collect(13) == 3 and source.collect(15) == 2 and source.collect(15) == 0
    refused("Failed", source.compact_retired, 0)
    refused("Failed", source.compact_retired, 257)
    with monkeypatch.context() as m:  # a batch folds nothing
        m.setattr(source, "_newest", None)
        assert [source.compact_retired(2) for _ in range(4)] == [2, 2, 1, 0]
    assert {r["entry_id"] for r in source.proofs().collect()} == {f"i{i}" for i in range(5)}
    assert source.collect(16) == 1 and source.compact_all_retired() == 1 and source.compact_all_retired() == 0
    assert source.proofs().count() == 6 and source.entries().count() == 3
    assert [r["outcome"] for r in source.apply(_mutations(spark, [(50, "i0", False, b"back")])).collect()] == ["fenced"]


def test_a_horizon_raised_between_steps_refuses_the_next_effect(spark, tmp_path):
    source, cache = CatalogueTable(spark, f"{tmp_path}/c", SCOPE), _cache(spark, f"{tmp_path}/k")
    source.apply(_mutations(spark, [(i, f"i{i}", False, b"x") for i in range(5)]))
    going = passes.begin_or_resume(SCOPE, ALLOW, source, cache)
    passes.apply_next_page(going, 10, ALLOW, source, cache)
    phases = []
    for stop in ("enumerate", "reconcile", "finish"):
        going, rest = passes.start_recovery(SCOPE, source.head(), ALLOW, cache, horizon=source.horizon())
        while going.phase != stop:
            going, rest = passes.step_recovery(going, rest, 10, ALLOW, source, cache, with_horizon=True)
        seq = source.log.snapshot().state["seq"]
        source.apply(_mutations(spark, [(seq + 1, f"{stop}-1", False, b"x"), (seq + 2, f"{stop}-2", False, b"y"), (seq + 3, f"{stop}-1", True, b"")]))
        source.collect(source.head())  # beyond the boundary of the recovery
        before = cache.log.snapshot()
        refused("HorizonExpired", passes.step_recovery, going, rest, 10, ALLOW, source, cache, with_horizon=True)
        assert cache.log.snapshot() == before and cache.recovery() == going
        phases.append(going.phase)
    assert phases == ["enumerate", "reconcile", "finish"]


def test_reconciling_goes_through_candidates_in_batches(spark, tmp_path):
    source, cache = CatalogueTable(spark, f"{tmp_path}/c", SCOPE), _cache(spark, f"{tmp_path}/k")
    source.apply(_mutations(spark, [(i, f"i{i}", False, b"x") for i in range(9)] + [(20 + i, f"i{i}", True, b"") for i in range(6)]))
    going = passes.begin_or_resume(SCOPE, ALLOW, source, cache)
    # The receiver holds live rows of entries that the source has retired since: only their proofs tell.
    live = spark.createDataFrame([(f"i{i}", i + 1, i + 1, False, bytearray(b"x"), True) for i in range(9)], ENTRIES)
    cache.save(going, passes.after_page(going, None, True), live)
    source.collect(source.head())
    source.compact_all_retired()
    going, rest = passes.start_recovery(SCOPE, source.head(), ALLOW, cache)
    steps = 0
    while going:
        going, rest = passes.step_recovery(going, rest, 2, ALLOW, source, cache)
        steps += 1
    assert {(r["entry_id"], r["deleted"]) for r in cache.entries().collect()} == {(f"i{i}", i < 6) for i in range(9)} and steps >= 6
