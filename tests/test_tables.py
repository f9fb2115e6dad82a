"""Durable tables: commits, replicas, passes, recovery, artifacts, epochs, streams, frames."""

import hashlib
import io

import pytest
from pyspark.sql import functions as F

from tidemark.operators.history import HydrationQueue
from tidemark.plans import history, passes, transfer
from tidemark.plans.follower import Capabilities, Pass, StepGate, begin_pass, begin_pass_with_page, catch_up, check_open_page, check_page, step
from tidemark.plans.freshness import Freshness
from tidemark.schema import ENTRIES, RECORDS, Limits, PageRequest, Refusal, Scope
from tidemark.sources import frames
from tidemark.sources.commitlog import CommitLog
from tidemark.sources.epochs import EpochLedger, EpochReplica, EpochSource, Stamped
from tidemark.sources.memory import MemoryAuthorizer, MemorySource, MemoryStore
from tidemark.sources.tables import ArtifactCache, ArtifactTable, CatalogueTable, RecordTable, ReplicaTable
from tidemark.streaming.follow import follow

SCOPE = Scope("device-a", "origin", "transcript", "first", "text-v1", "epoch-1")
LIMITS = Limits(3, 100, 50)
ALLOW = MemoryAuthorizer()


def _facts(spark, first, last):
    return spark.createDataFrame([(i, f"fact-{i}", bytearray(f"message-{i}".encode())) for i in range(first, last + 1)], "seq bigint, record_id string, payload binary")


def refused(code, call, *args, **kwargs):
    with pytest.raises(Refusal) as e:
        call(*args, **kwargs)
    assert e.value.code == code


def test_commit_log(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/t", "k", RECORDS)
    row = spark.createDataFrame([(1, "a", bytearray(b"x"))], RECORDS)
    at = log.snapshot()
    first = log.commit(at, {"n": 1}, row)
    refused("Stale", log.commit, at, {"n": 2}, row)
    log.fail_next = "Failed"
    refused("Failed", log.commit, first, {"n": 2}, row)
    log.fail_next = "Uncertain"
    refused("Uncertain", log.commit, first, {"n": 2}, row)
    assert log.snapshot().state == {"n": 2} and log.read().count() == 2 and log.read(first).count() == 1
    for i in range(40):
        log.commit(log.snapshot(), {"n": i})
    assert CommitLog(spark, f"{tmp_path}/t", "k", RECORDS).snapshot().state == {"n": 39} and log.read().count() == 2
    assert log.compact(log.snapshot()).segments.__len__() == 1 and log.read().count() == 2
    refused("ForeignTable", CommitLog, spark, f"{tmp_path}/t", "other", RECORDS)


def test_catch_up_and_history(spark, tmp_path):
    source = RecordTable(spark, f"{tmp_path}/s", SCOPE)
    assert source.append(_facts(spark, 1, 5)) == 5
    assert source.append(_facts(spark, 4, 7)) == 7  # known records are quiet
    refused("ConflictingRecord", source.append, _facts(spark, 7, 7).withColumn("payload", F.lit(b"other")))
    refused("Stale", source.append, _facts(spark, 8, 8), source.head(SCOPE).__class__(SCOPE, 3))
    store = ReplicaTable(spark, f"{tmp_path}/r")
    assert catch_up(SCOPE, LIMITS, ALLOW, source, store) == 7 and store.count() == 7
    page = source.page(PageRequest(SCOPE, 4, 7, LIMITS))
    assert store.apply(SCOPE, 4, page) == 7  # a replay changes nothing
    refused("Stale", store.apply, SCOPE, 3, _facts(spark, 20, 20).select((F.col("seq") - 11).alias("position"), "record_id", "payload"))
    assert [r["position"] for r in store.read_after(SCOPE, 5, LIMITS).collect()] == [6, 7]
    source.prune_through(2)
    refused("Pruned", source.page, PageRequest(SCOPE, 1, 7, LIMITS))
    refused("IdentityChanged", source.head, Scope("device-a", "origin", "transcript", "second", "text-v1", "epoch-1"))

    view = ReplicaTable(spark, f"{tmp_path}/h")
    assert view.install_tail(SCOPE, 1, source.tail(SCOPE, Limits(2, 100, 50)))["lower_bound"] == 6
    older = source.older(SCOPE, 6, LIMITS)
    assert view.install_older(SCOPE, 1, older)["lower_bound"] == 3 and view.count() == 5
    assert view.install_older(SCOPE, 1, older)["lower_bound"] == 3 and view.count() == 5
    source.append(_facts(spark, 8, 8))
    going = begin_pass_with_page(SCOPE, LIMITS, ALLOW, source, view)
    assert going.complete and view.progress()["live_head"] == 8
    view.fence_deletion(SCOPE)
    refused("Deleted", view.install_tail, SCOPE, 5, source.tail(SCOPE, LIMITS))


def _mutations(spark, rows):
    return spark.createDataFrame([(s, k, d, None if d else bytearray(p)) for s, k, d, p in rows], "seq bigint, entry_id string, is_del boolean, payload binary")


def test_catalogue_passes_and_recovery(spark, tmp_path):
    source = CatalogueTable(spark, f"{tmp_path}/c", SCOPE)
    rows = [(i, f"item-{i}", False, b"live") for i in range(6)] + [(6, "item-0", True, b""), (7, "item-1", True, b""), (8, "item-5", False, b"new"), (9, "item-0", False, b"back"), (10, "item-5", False, b"new")]
    told = source.apply(_mutations(spark, rows[:7])).collect()
    assert len(told) == 7
    source.apply(_mutations(spark, rows[7:]))
    assert source.head() == 9
    entries = {r["entry_id"]: (r["creation"], r["revision"], r["deleted"]) for r in source.entries().collect()}
    assert entries == {"item-0": (1, 7, True), "item-1": (2, 8, True), "item-2": (3, 3, False), "item-3": (4, 4, False), "item-4": (5, 5, False), "item-5": (6, 9, False)}

    cache = passes.CatalogueCache(CommitLog(spark, f"{tmp_path}/k", "catalogue-cache", ENTRIES))
    going = passes.begin_or_resume(SCOPE, ALLOW, source, cache)
    assert passes.begin_or_resume(SCOPE, ALLOW, source, cache) == going  # resumed
    while going.active:
        going = passes.apply_next_page(going, 4, ALLOW, source, cache)
    assert going.completed == 9 and cache.count() == 6
    assert passes.begin_or_resume(SCOPE, ALLOW, source, cache) is None

    assert source.collect(8) == 1
    assert source.compact_retired() == 1 and source.entries().count() == 5 and source.proofs().count() == 1
    refused("InvalidHorizon", source.collect, 7)
    assert [r["outcome"] for r in source.apply(_mutations(spark, [(15, "item-0", False, b"again")])).collect()] == ["fenced"]
    source.apply(_mutations(spark, [(20, "item-2", False, b"v2")]))
    going = passes.begin_or_resume(SCOPE, ALLOW, source, cache, with_horizon=True)
    going = passes.apply_next_page(going, 4, ALLOW, source, cache, with_horizon=True)
    assert going.completed == 10 and going.active is None

    going, rest = passes.start_recovery(SCOPE, source.head(), ALLOW, cache)
    assert cache.count() == 2 and rest.count() == 4  # markers stay, live rows are candidates
    while going:
        going, rest = passes.step_recovery(going, rest, 3, ALLOW, source, cache)
    assert {r["entry_id"] for r in cache.entries().filter("NOT deleted").collect()} == {"item-2", "item-3", "item-4", "item-5"}
    assert passes.reset_catalogue(SCOPE, ALLOW, cache).completed == 0 and cache.count() == 2


def test_pass_rules():
    p = passes.after_begin(SCOPE, None, 5)
    assert passes.after_begin(SCOPE, None, 0).active is None
    refused("Stale", passes.after_begin, SCOPE, p, 9)
    refused("InvalidPage", passes.after_page, p, None, False)
    done = passes.after_page(p, None, True)
    refused("Stale", passes.after_begin, SCOPE, done, 5)
    refused("HorizonExpired", passes.check_coverage, 4, 5)
    passes.check_coverage(5, 5)
    refused("GenerationExhausted", passes.after_reset, SCOPE, passes.Progress(SCOPE, 1, passes.MAX_GENERATION))


class _Artifacts:
    def __init__(self, data):
        self.data, self.revision, self.deleted = data, 1, False

    def manifest(self, artifact_id):
        return {"revision": self.revision, "length": len(self.data), "digest": hashlib.sha256(self.data).hexdigest(), "deleted": self.deleted}

    def chunk(self, artifact_id, revision, offset, size):
        return self.data[offset : offset + size]


def test_artifact_transfer(spark, tmp_path):
    source, cache = _Artifacts(b"x" * 25), ArtifactCache(spark, f"{tmp_path}/a")
    for want in (10, 20, 25, 25):
        assert transfer.transfer_one("f", 10, source, cache)["next"] == want
    assert cache.read_verified("f") is None
    assert transfer.publish_if_current("f", source, cache)["verified"]
    assert b"".join(bytes(r["bytes"]) for r in cache.read_verified("f").collect()) == source.data
    source.data, source.revision = b"y" * 5, 2
    refused("Incomplete", transfer.publish_if_current, "f", source, cache)
    cache.append("f", 0, b"z" * 5)
    refused("HashMismatch", cache.publish, "f")
    source.deleted, source.revision = True, 3
    transfer.transfer_one("f", 10, source, cache)
    source.deleted, source.revision = False, 4
    refused("Fenced", transfer.transfer_one, "f", 10, source, cache)
    cache.revoke()
    refused("Revoked", transfer.transfer_one, "g", 10, source, cache)


def test_epochs(spark, tmp_path):
    table, ledger = RecordTable(spark, f"{tmp_path}/s", SCOPE), EpochLedger(spark, f"{tmp_path}/e")
    table.append(_facts(spark, 1, 3))
    old = EpochSource(table, ledger, "auth", None)
    replica = EpochReplica(ReplicaTable(spark, f"{tmp_path}/r"), "auth")
    page = PageRequest(SCOPE, 0, 3, LIMITS)
    refused("StaleEpoch", replica.apply, old.capture(SCOPE, "page", page), 0)
    replica.observe(old.capture(SCOPE, "head", SCOPE))
    late = old.capture(SCOPE, "page", page)
    new = EpochSource(table, ledger, "auth", 1)
    refused("Superseded", old.capture, SCOPE, "head", SCOPE)
    replica.observe(new.capture(SCOPE, "head", SCOPE))
    refused("StaleEpoch", replica.apply, late, 0)
    assert replica.apply(new.capture(SCOPE, "page", page), 0) == 3
    refused("Stale", ledger.claim, "auth", 1)


def test_follower_ports():
    source, store = MemorySource(SCOPE), MemoryStore()
    for i in range(4):
        source.append(f"f{i}", b"abc")
    refused("ConflictingRecord", source.append, "f0", b"other")
    assert begin_pass(SCOPE, ALLOW, source, store).target == 4
    refused("Denied", begin_pass, SCOPE, MemoryAuthorizer("Denied"), source, store)
    source.reader_required = 4
    refused("MissingReader", begin_pass, SCOPE, ALLOW, source, store, Capabilities(1, 0, 1, 0))
    source.writer_required, source.reader_required = 8, 0
    assert begin_pass(SCOPE, ALLOW, source, store, Capabilities()).target == 4  # readers ignore writer bits
    refused("InvalidSupport", Capabilities, 2, 0, 1, 0)
    going = begin_pass(SCOPE, ALLOW, source, store)
    gate = StepGate()
    assert gate.cancel() and not step(going, Limits(2, 8, 8), ALLOW, source, store, gate) and store.load(SCOPE) is None
    gate = StepGate()
    assert not step(going, Limits(2, 8, 8), ALLOW, source, store, gate) and going.position == 2 and not gate.cancel()
    store.fail_next = "Uncertain"
    refused("Uncertain", step, going, Limits(2, 8, 8), ALLOW, source, store)
    assert store.load(SCOPE) == 4  # it was saved, only the reply was lost
    refused("SourceBehindCheckpoint", lambda: begin_pass(SCOPE, ALLOW, MemorySource(SCOPE), store))
    assert Pass(SCOPE, 4, 4).complete


def test_freshness():
    now = [100.0]
    source, store = MemorySource(SCOPE), MemoryStore()
    source.append("a", b"x")
    owner = Freshness(SCOPE, 10.0, lambda: now[0], lambda w: 0.0, 1.0, 8.0)
    ports = (LIMITS, ALLOW, source, store)
    read = lambda: owner.read(True, *ports, lambda s, scope: s.load(scope))
    assert read()[0] is None and source.head_reads == 0
    assert [owner.drive(*ports) for _ in range(4)] == ["checked", "applied", "checked", "waiting"]
    value, seen = read()
    assert value == 1 and seen.head == 1 and not seen.pending
    now[0] += 10
    assert not read()[1].pending
    now[0] += 0.5
    assert read()[1].pending
    denied = (LIMITS, MemoryAuthorizer("Unverifiable"), source, store)
    refused("Unverifiable", owner.drive, *denied)
    assert owner.observed().retry_at == now[0] + 0.5 and owner.window == 2.0
    assert owner.drive(*denied) == "waiting"
    now[0] -= 50
    seen = owner.observed()
    assert seen.clock_generation == 1 and seen.checked_at is None and seen.retry_at == now[0] + 0.5
    now[0] += 1
    assert owner.drive(*ports) == "checked" and owner.window == 1.0
    owner.request()
    refused("Denied", owner.drive, LIMITS, MemoryAuthorizer("Denied"), source, store)
    refused("Stopped", owner.drive, *ports)
    owner.resume()
    assert owner.drive(*ports) == "checked"
    always = Freshness(SCOPE, "always", lambda: now[0], lambda w: w, 1.0, 8.0)
    before = source.head_reads
    always.read(True, *ports, lambda s, scope: None)
    always.read(False, *ports, lambda s, scope: None)
    assert source.head_reads == before + 1


def test_stream_follow(spark, tmp_path):
    rows = _facts(spark, 1, 20).select(F.col("seq").alias("position"), "record_id", "payload")
    rows.repartitionByRange(4, "position").write.parquet(f"{tmp_path}/in")
    log = CommitLog(spark, f"{tmp_path}/out", "record-replica", RECORDS)
    batches = follow(spark, f"{tmp_path}/in", rows.schema, log, f"{tmp_path}/progress", max_files=1)
    assert batches == 4 and follow(spark, f"{tmp_path}/in", rows.schema, log, f"{tmp_path}/progress") == 0
    assert log.read().count() == 20 and log.read().select("position").distinct().count() == 20


def test_a_new_checkpoint_counts_its_batches_anew(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/out", "record-replica", RECORDS)
    for part, (a, b) in enumerate(((1, 10), (11, 20))):
        rows = _facts(spark, a, b).select(F.col("seq").alias("position"), "record_id", "payload")
        rows.repartitionByRange(3, "position").write.parquet(f"{tmp_path}/in{part}")
        assert follow(spark, f"{tmp_path}/in{part}", rows.schema, log, f"{tmp_path}/progress{part}", max_files=1) == 3
    assert log.read().count() == 20


def test_pages_with_gaps_and_wrong_answers(spark, tmp_path):
    source = RecordTable(spark, f"{tmp_path}/s", SCOPE)
    source.append(_facts(spark, 1, 6))
    at = source.log.snapshot()
    source.log.commit(at, at.state, source.log.read(at).filter("position <> 3"), replace=True)
    refused("Pruned", source.page, PageRequest(SCOPE, 0, 6, LIMITS))
    ask = PageRequest(SCOPE, 0, 6, Limits(3, 100, 50))
    page = _facts(spark, 1, 3).select(F.col("seq").alias("position"), "record_id", "payload")
    check_page(ask, page)
    refused("Noncontiguous", check_page, ask, page.filter("position <> 2"))
    refused("WrongRecord", check_page, ask, page.withColumn("record_id", F.lit("same")))
    refused("OversizedRecord", check_page, PageRequest(SCOPE, 0, 6, Limits(3, 100, 2)), page)
    refused("BoundsExceeded", check_page, PageRequest(SCOPE, 0, 6, Limits(2, 100, 50)), page)
    refused("Noncontiguous", check_page, PageRequest(SCOPE, 0, 2, Limits(3, 100, 50)), page)
    refused("EmptyPage", check_page, ask, page.filter("false"))
    refused("SourceBehindCheckpoint", check_open_page, PageRequest(SCOPE, 5, 4, LIMITS), None)
    refused("EmptyPage", check_open_page, PageRequest(SCOPE, 0, 6, LIMITS), None)


def test_history_on_demand(spark, tmp_path):
    source, view = RecordTable(spark, f"{tmp_path}/s", SCOPE), ReplicaTable(spark, f"{tmp_path}/v")
    source.append(_facts(spark, 1, 9))
    queue = HydrationQueue()
    queue.request(4)
    progress = history.hydrate(SCOPE, queue, Limits(2, 100, 50), ALLOW, source, view)
    assert progress["lower_bound"] == 4 and queue.waiters == 0 and view.count() == 6
    refused("Denied", history.fetch_older, SCOPE, LIMITS, MemoryAuthorizer("Denied"), source, view)
    rows = source.log.read()
    refused("InvalidBoundary", history.check_history, rows, 1, 8, 1, Limits(20, 1000, 50))
    refused("BoundsExceeded", history.check_history, rows, 1, 9, 1, Limits(5, 1000, 50))
    refused("Noncontiguous", history.check_history, rows.withColumn("position", F.when(F.col("position") == 4, 40).otherwise(F.col("position"))), 1, 9, 1, Limits(20, 1000, 50))


def test_recovery_survives_any_step(spark, tmp_path):
    source = CatalogueTable(spark, f"{tmp_path}/c", SCOPE)
    source.apply(_mutations(spark, [(i, f"item-{i}", False, b"live") for i in range(7)]))
    log = CommitLog(spark, f"{tmp_path}/k", "catalogue-cache", ENTRIES)
    cache = passes.CatalogueCache(log)
    going = passes.begin_or_resume(SCOPE, ALLOW, source, cache)
    while going.active:
        going = passes.apply_next_page(going, 4, ALLOW, source, cache)
    source.apply(_mutations(spark, [(10, "item-2", True, b"")]))
    passes.start_recovery(SCOPE, source.head(), ALLOW, cache)
    for _ in range(12):
        again = passes.CatalogueCache(CommitLog(spark, f"{tmp_path}/k", "catalogue-cache", ENTRIES))  # as after a crash
        going = again.recovery()
        if going is None:
            break
        refused("Stale", passes.step_recovery, passes.Recovery(going.progress, going.boundary + 1, going.phase), None, 3, ALLOW, source, again)
        again.log.fail_next = "Failed"
        refused("Failed", passes.step_recovery, going, None, 3, ALLOW, source, again)
        passes.step_recovery(going, None, 3, ALLOW, source, again)
    assert going is None and {(r["entry_id"], r["deleted"]) for r in cache.entries().collect()} == {(f"item-{i}", i == 2) for i in range(7)}
    assert cache.entry("item-3")["revision"] == cache.revision("item-3") == 4 and cache.revision("none") == 0
    # A source that has forgotten what a candidate proves is refused.
    behind = CatalogueTable(spark, f"{tmp_path}/b", SCOPE)
    behind.apply(_mutations(spark, [(i, f"item-{6 - i}", False, b"live") for i in range(7)] + [(8 + i, f"new-{i}", False, b"x") for i in range(3)]))
    going, rest = passes.start_recovery(SCOPE, behind.head(), ALLOW, cache)
    refused("WrongPayload", passes.step_recovery, going, rest, 100, ALLOW, behind, cache)
    refused("InvalidRecovery", passes.check_recovery, passes.Recovery(going.progress, going.boundary, "finish"))


def test_passes_read_one_snapshot(spark, tmp_path):
    """A compaction between two reads of a page changes nothing."""
    source, cache = CatalogueTable(spark, f"{tmp_path}/c", SCOPE), passes.CatalogueCache(CommitLog(spark, f"{tmp_path}/k", "catalogue-cache", ENTRIES))
    source.apply(_mutations(spark, [(i, f"item-{i}", False, b"live") for i in range(4)] + [(5, "item-1", True, b""), (6, "item-3", False, b"more")]))
    going = passes.begin_or_resume(SCOPE, ALLOW, source, cache)
    source.collect(6)
    at = source.snapshot()
    assert source.compact_retired() == 1 and source.entries(at).count() == 4 and source.proofs(at).count() == 0 and source.proofs().count() == 1

    class Compacting(MemoryAuthorizer):
        def authorize(self, scope):
            super().authorize(scope)
            source.apply(_mutations(spark, [(100 + self.calls, "item-0", False, b"v%d" % self.calls)]))

    done = passes.apply_next_page(going, 10, Compacting(), source, cache)
    assert done.active is None and cache.count() == 3
    refused("Stale", source.apply, _mutations(spark, [(200, "item-0", False, b"z")]), 1)
    refused("Stale", source.collect, 6, (1, 1))
    refused("InvalidOrder", passes._check_manifest, [{"entry_id": "b", "creation": 2, "revision": 2}, {"entry_id": "a", "creation": 1, "revision": 1}], passes.CataloguePass(0, 9, 1), 5)


def test_writes_do_not_grow_with_the_catalogue(spark, tmp_path):
    source = CatalogueTable(spark, f"{tmp_path}/c", SCOPE)
    source.apply(_mutations(spark, [(i, f"item-{i}", False, b"live") for i in range(2000)]))
    source.apply(_mutations(spark, [(3000, "item-7", False, b"new")]))
    last = source.log.snapshot().segments[-1]
    assert spark.read.parquet(f"{tmp_path}/c/data/{last}").count() == 1 and source.entries().count() == 2000
    source.COMPACT_AFTER = 2
    source.apply(_mutations(spark, [(3001, "item-7", True, b"")]))
    assert len(source.log.snapshot().segments) == 1 and source.entries().filter("deleted").count() == 1


def test_durable_pins_and_epochs(spark, tmp_path):
    table = RecordTable(spark, f"{tmp_path}/s", SCOPE)
    table.append(_facts(spark, 1, 9))
    receipt = table.register_pin("a", 3, 10, 20)
    refused("Exists", table.register_pin, "a", 4, 11, 30)
    refused("ClockRegressed", table.register_pin, "b", 4, 9, 30)
    again = RecordTable(spark, f"{tmp_path}/s", SCOPE)
    moved = again.refresh_pin(receipt, 5, 12, 30)
    refused("Stale", again.refresh_pin, receipt, 6, 13, 40)
    refused("ProgressRegressed", again.refresh_pin, moved, 4, 13, 40)
    assert again.prune_with_retention(8, None, 15) == 5 and table.prune_with_retention(8, None, 30) == 8 and table.pin("a") == moved
    refused("PinOutOfRange", table.register_pin, "c", 2, 31, 50)

    replica = ReplicaTable(spark, f"{tmp_path}/r")
    fenced = EpochReplica(replica, "auth")
    fenced.observe(Stamped("auth", SCOPE, 2, None))
    reopened = EpochReplica(ReplicaTable(spark, f"{tmp_path}/r"), "auth")
    refused("StaleEpoch", reopened.observe, Stamped("auth", SCOPE, 1, None))
    page = table.log.read().filter("position <= 2")
    refused("StaleEpoch", reopened.apply, Stamped("auth", SCOPE, 1, page), 0)
    refused("WrongAuthority", reopened.apply, Stamped("other", SCOPE, 2, page), 0)
    assert reopened.apply(Stamped("auth", SCOPE, 2, page), 0) == 2 and reopened.floor == 2


def test_artifact_source(spark, tmp_path):
    source, cache = ArtifactTable(spark, f"{tmp_path}/s"), ArtifactCache(spark, f"{tmp_path}/c")
    big = bytes(range(256)) * 600
    put = lambda *rows: dict(map(tuple, source.upsert(spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "artifact_id string, payload binary")).collect()))
    assert put(("a", big), ("b", b"small"), ("c", b"")) == {"a": "accepted", "b": "accepted", "c": "accepted"}
    assert put(("a", big), ("b", b"other")) == {"a": "quiet", "b": "accepted"}
    refused("Missing", source.manifest, "z")
    first = source.manifest("a")
    assert source.chunk("a", first["revision"], 65000, 2000) == big[65000:67000]
    refused("InvalidRequest", source.chunk, "a", first["revision"], len(big), 10)
    while transfer.transfer_one("a", 60000, source, cache)["next"] < len(big):
        pass
    assert transfer.publish_if_current("a", source, cache)["verified"] and cache.lookup("a")["next"] == len(big)
    assert b"".join(bytes(r["bytes"]) for r in cache.read_verified("a").collect()) == big
    at = cache.log.snapshot()
    cache.log.commit(at, at.state, cache.log.read(at).withColumn("bytes", F.when(F.col("offset") == 0, F.lit(b"broken")).otherwise(F.col("bytes"))), replace=True)
    refused("HashMismatch", cache.read_verified, "a")  # a flag is not enough
    gone = source.delete("a")
    assert source.delete("a") == gone and put(("a", b"back")) == {"a": "fenced"}
    refused("Stale", source.chunk, "a", first["revision"], 0, 10)
    assert transfer.transfer_one("a", 10, source, cache)["deleted"] and cache.read_verified("a") is None
    cache.accept("d", 1, 9, hashlib.sha256(b"123456789").hexdigest())
    assert cache.append_all("d", [(0, b"1234"), (4, b"56789")])["next"] == 9 and cache.publish("d")["verified"]
    refused("WrongLength", transfer.check_chunk, {"deleted": False, "revision": 1, "length": 9}, 0, 5, b"1234")
    cache.revoke()
    assert cache.lookup("d") is None


def test_frames(spark, tmp_path):
    bodies = [b"", b"abc", bytes(1000)]
    (tmp_path / "f.bin").write_bytes(b"".join(map(frames.encode_frame, bodies)))
    got = frames.read_frames(spark, f"{tmp_path}/f.bin").orderBy("frame").collect()
    assert [bytes(r["body"]) for r in got] == bodies
    refused("FrameTooLarge", frames.encode_frame, bytes((1 << 20) + 1))
    refused("FrameTooLarge", frames.read_frame, io.BytesIO(b"\xff\xff\xff\xff"))
    refused("TruncatedFrame", frames.read_frame, io.BytesIO(b"\0\0\0\5ab"))


def test_recovery_enumerates_many_pages_in_a_step(spark, tmp_path):
    source = CatalogueTable(spark, f"{tmp_path}/c", SCOPE)
    source.apply(_mutations(spark, [(i, f"item-{i:02d}", False, b"live") for i in range(30)] + [(40 + i, f"item-{i:02d}", True, b"") for i in range(0, 30, 7)]))
    cache = passes.CatalogueCache(CommitLog(spark, f"{tmp_path}/k", "catalogue-cache", ENTRIES))
    going, rest = passes.start_fresh_recovery(SCOPE, ALLOW, source, cache)
    phases = []
    for again in (False, True):
        while going:
            phases.append(going.phase)
            going, rest = passes.step_recovery(going, rest, 4, ALLOW, source, cache, with_horizon=True, pages=5)
        assert sorted(tuple(r) for r in cache.entries().collect()) == sorted(tuple(r) for r in source.entries().collect())
        if not again:
            going, rest = passes.start_recovery(SCOPE, source.head(), ALLOW, cache)
            assert rest.count() == 25
    assert phases == ["enumerate", "enumerate", "reconcile", "finish"] * 2

    # A floor above what the source says refuses the step, whose pages before are kept.
    behind = spark.createDataFrame([("item-22", 23, 90)], "entry_id string, creation bigint, revision bigint")
    going, rest = passes.start_recovery(SCOPE, 99, ALLOW, cache, behind)
    source.apply(_mutations(spark, [(100 + i, "item-01", False, str(i).encode()) for i in range(64)]))
    going, rest = passes.step_recovery(going, rest, 4, ALLOW, source, cache, pages=9)
    assert going.progress.active.cursor == (20, "item-19")
    refused("WrongPayload", passes.step_recovery, going, rest, 4, ALLOW, source, cache, pages=9)
