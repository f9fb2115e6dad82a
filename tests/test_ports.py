"""Ports filled by plain tables, and evidence that only its source can make."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.operators.records import Positioned
from tidemark.plans import history, passes
from tidemark.schema import ENTRIES, Limits, PageRequest, Refusal, Scope
from tidemark.sources.commitlog import CommitLog
from tidemark.sources.epochs import EpochLedger, EpochReplica, EpochSource, Sealed, Stamped
from tidemark.sources.memory import MemoryAuthorizer
from tidemark.sources.tables import RecordTable, ReplicaTable
from tidemark.sources.views import CatalogueView, RecordView

SCOPE = Scope("device-a", "origin", "transcript", "first", "text-v1", "epoch-1")
OTHER = Scope("device-a", "origin", "transcript", "second", "text-v1", "epoch-1")
LIMITS = Limits(3, 100, 50)
ALLOW = MemoryAuthorizer()


def refused(code, call, *args, **kwargs):
    with pytest.raises(Refusal) as e:
        call(*args, **kwargs)
    assert e.value.code == code


def _records(spark, ids):
    return spark.createDataFrame([(i, f"r{i}", f"message-{i}") for i in ids], "id bigint, record_id string, payload string")


def test_history_of_a_view(spark, tmp_path):
    source, view = RecordView(Positioned(_records(spark, range(10)), "id", 1), SCOPE, floor=2), ReplicaTable(spark, f"{tmp_path}/r")
    assert history.fetch_tail(SCOPE, LIMITS, ALLOW, source, view)["lower_bound"] == 8
    for low in (5, 3, 3):  # the floor is at 2
        assert history.fetch_older(SCOPE, LIMITS, ALLOW, source, view)["lower_bound"] == low
    assert sorted(r["position"] for r in view.log.read().collect()) == list(range(3, 11))
    refused("IdentityChanged", source.tail, OTHER, LIMITS)
    refused("OversizedRecord", source.tail, SCOPE, Limits(3, 100, 4))
    empty = RecordView(Positioned(_records(spark, []), "id", 1), SCOPE)
    assert history.fetch_tail(SCOPE, LIMITS, ALLOW, empty, ReplicaTable(spark, f"{tmp_path}/e"))["live_head"] == 0


def test_gap_in_a_view_is_refused(spark, tmp_path):
    source = RecordView(Positioned(_records(spark, [0, 1, 2, 3, 5]), "id", 1), SCOPE)
    refused("InvalidBoundary", history.fetch_tail, SCOPE, LIMITS, ALLOW, source, ReplicaTable(spark, f"{tmp_path}/r"))


def test_catalogue_pass_over_a_view(spark, tmp_path):
    # Sparse creations, so ranges widen; two states hidden, and one entry moved since a completed revision.
    rows = [(f"e{k}", k * k, k * k, k % 5 == 0, None if k % 5 == 0 else bytearray(b"v"), k not in (10, 15)) for k in range(1, 30)]
    rows[6] = ("e7", 49, 850, False, bytearray(b"late"), True)
    states = spark.createDataFrame(rows, ENTRIES)
    cache = passes.CatalogueCache(CommitLog(spark, f"{tmp_path}/c", "catalogue-cache", ENTRIES))
    source = CatalogueView(spark, states, SCOPE, 850)
    going = passes.begin_or_resume(SCOPE, ALLOW, source, cache)
    while going and going.active:
        going = passes.apply_next_page(going, 7, ALLOW, source, cache)
    got = {r["entry_id"]: (r["creation"], r["revision"], r["deleted"]) for r in cache.entries().collect()}
    assert got == {r[0]: (r[1], r[2], r[3]) for r in rows if r[5]}
    assert passes.begin_or_resume(SCOPE, ALLOW, source, cache) is None
    assert [r["entry_id"] for r in source.manifest_page(850, 841, None, 7)[0]] == ["e7"]
    covered = CatalogueView(spark, states, SCOPE, 851, horizon=851)
    refused("HorizonExpired", passes.begin_or_resume, SCOPE, ALLOW, covered, cache, True)


def test_only_sealed_evidence_is_admitted(spark, tmp_path):
    table, ledger, sealed = RecordTable(spark, f"{tmp_path}/s", SCOPE), EpochLedger(spark, f"{tmp_path}/e"), Sealed(b"k" * 16)
    table.append(_records(spark, range(1, 8)).select(F.col("id").alias("seq"), "record_id", F.col("payload").cast("binary").alias("payload")))
    source = EpochSource(table, ledger, "auth", None, sealed)
    replica = EpochReplica(ReplicaTable(spark, f"{tmp_path}/r"), "auth", sealed)
    head, page = source.capture(SCOPE, "head", SCOPE), source.capture(SCOPE, "page", PageRequest(SCOPE, 0, 3, LIMITS))
    refused("StaleEpoch", replica.apply, page, 0)

    # Made by a caller, of another key, of a later epoch or scope, of another kind: none is admitted, and none moves the floor.
    refused("Unadmitted", replica.observe, Stamped("auth", SCOPE, 9, head.value))
    refused("Unadmitted", replica.observe, replace(head, seal=Sealed(b"x" * 16).seal(head, "head")))
    refused("Unadmitted", replica.observe, replace(head, epoch=9))
    refused("Unadmitted", replica.observe, replace(head, scope=OTHER))
    refused("Unadmitted", replica.observe, replace(head, value=replace(head.value, position=99)))
    assert replica.floor == 0 and replica.observe(head) == 1
    refused("Unadmitted", replica.apply, replace(page, value=page.value.withColumn("payload", F.lit(b"forged"))), 0)
    refused("Unadmitted", replica.apply, replace(page, value=page.value.filter("position < 3")), 0)
    refused("Unadmitted", replica.install_tail, replace(page, kind="tail"), 1)
    refused("Unadmitted", replica.apply, replace(page, value=spark.range(300).selectExpr("id + 1 AS position", "'a' AS record_id", "CAST('b' AS BINARY) AS payload")), 0)
    assert replica.apply(page, 0) == 3 == replica.apply(page, 0)

    tail = source.capture(SCOPE, "tail", SCOPE, LIMITS)
    refused("Unadmitted", replica.install_tail, replace(tail, value=tail.value | {"oldest": 2}), 1)
    assert ReplicaTable(spark, f"{tmp_path}/r").count() == 3


def test_admission_is_bound_to_the_replica(spark, tmp_path):
    sealed = Sealed(b"k" * 16)
    EpochReplica(ReplicaTable(spark, f"{tmp_path}/r"), "auth", sealed)
    bare = ReplicaTable(spark, f"{tmp_path}/r")
    refused("Unadmitted", EpochReplica, bare, "auth")
    refused("WrongBinding", EpochReplica, bare, "auth", Sealed(b"x" * 16))
    plan = _records(spark, [1]).select(F.col("id").alias("position"), "record_id", F.col("payload").cast("binary").alias("payload"))
    refused("Unadmitted", bare.apply, SCOPE, 0, plan)
    refused("InvalidKey", Sealed, b"short")
    bare.fence_deletion(SCOPE)
    refused("Unadmitted", EpochReplica, bare, "auth")  # a fence keeps the binding


def test_head_must_be_readable(spark, tmp_path):
    table, ledger = RecordTable(spark, f"{tmp_path}/s", SCOPE), EpochLedger(spark, f"{tmp_path}/e")
    table.append(_records(spark, [1]).select(F.col("id").alias("seq"), "record_id", F.col("payload").cast("binary").alias("payload")), reader=4)
    head = EpochSource(table, ledger, "auth", None).capture(SCOPE, "head", SCOPE)
    replica = ReplicaTable(spark, f"{tmp_path}/r")
    refused("MissingReader", EpochReplica(replica, "auth").observe, head)
    refused("WrongBinding", EpochReplica(replica, "auth", reader=4).observe, replace(head, scope=OTHER))
    refused("UnsupportedVersion", EpochReplica(replica, "auth", reader=4).observe, replace(head, value=replace(head.value, version=9)))
    assert EpochReplica(replica, "auth").floor == 0 and EpochReplica(replica, "auth", reader=4).observe(head) == 1


def _pass(states, spark, path, head, step, **more):
    """Cache and refusal of a pass in pages of 4."""
    cache = passes.CatalogueCache(CommitLog(spark, path, "catalogue-cache", ENTRIES))
    source = CatalogueView(spark, states, SCOPE, head)
    going = passes.begin_or_resume(SCOPE, ALLOW, source, cache)
    try:
        while going.active:
            going = step(going, 4, ALLOW, source, cache, **more)
    except Refusal as e:
        return cache, e.code
    return cache, None


def test_many_pages_in_one_plan(spark, tmp_path):
    """Rounds of pages end as the pages one by one do, in fewer commits."""
    rows = [(f"e{k:02d}", k * k, k * k, k % 5 == 0, None if k % 5 == 0 else bytearray(b"v"), k not in (10, 15)) for k in range(1, 25)]
    rows += [("a-tie", 400, 401, False, bytearray(b"v"), True)]  # one creation twice, at the end of a page
    states = spark.createDataFrame(rows, ENTRIES)
    told = lambda cache: sorted(tuple(r) for r in cache.entries().drop("payload").collect())
    one, _ = _pass(states, spark, f"{tmp_path}/one", 576, passes.apply_next_page)
    many, refusal = _pass(states, spark, f"{tmp_path}/many", 576, passes.apply_pages, pages=3)
    assert refusal is None and told(many) == told(one) and many.progress() == one.progress()
    assert (one.log.snapshot().version, many.log.snapshot().version) == (7, 3)  # the begin, then six pages or two rounds


@pytest.mark.parametrize("odd, code", [
    (("e10", 10, 10, False, bytearray(b"x" * 99), True), "OversizedEntry"), (("e10", 10, 10, True, bytearray(b"x"), True), "WrongPayload"),
    (("e10", 10, 9, False, bytearray(b"x"), True), "InvalidOrder"), (("e11", 10, 10, False, bytearray(b"x"), True), "InvalidOrder"),
])
def test_pages_before_a_refused_one_are_kept(spark, tmp_path, odd, code):
    """The third page of five is refused; the two before it are in the cache, with their cursor, as if each had come alone."""
    states = spark.createDataFrame([odd if k == 10 else (f"e{k:02d}", k, k, False, bytearray(b"v"), True) for k in range(1, 21)], ENTRIES)
    one, first = _pass(states, spark, f"{tmp_path}/one", 20, passes.apply_next_page, max_bytes=50)
    many, second = _pass(states, spark, f"{tmp_path}/many", 20, passes.apply_pages, max_bytes=50)
    assert first == second == code
    assert many.progress() == one.progress() and many.progress().active.cursor == (8, "e08") and many.count() == one.count() == 8
