"""Many artifacts and many streams at once."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.plans.history import hydrate_streams
from tidemark.plans.transfer import transfer_all, transfer_one
from tidemark.schema import Limits, Refusal, Scope
from tidemark.sources import commitlog, pins
from tidemark.sources.streams import StreamsReplica
from tidemark.sources.tables import ArtifactCache, ArtifactTable, RecordTable


def _told(df, *columns):
    return {r[columns[0]]: tuple(r[c] for c in columns[1:]) for r in df.collect()}


def test_transfer_of_many_artifacts(spark, tmp_path):
    source, cache = ArtifactTable(spark, f"{tmp_path}/s"), ArtifactCache(spark, f"{tmp_path}/c")
    put = lambda **rows: source.upsert(spark.createDataFrame([(k, bytearray(v)) for k, v in rows.items()], "artifact_id string, payload binary"))
    big = bytes(range(256)) * 700  # three chunks
    put(big=big, begun=big[::-1], wrong=b"0123456789", empty=b"", small=b"abc")
    cut = source.manifest("begun")
    assert transfer_one("begun", 60_000, source, cache)["next"] == 60_000  # not where the source cuts
    cache.accept("wrong", source.manifest("wrong")["revision"], 10, hashlib.sha256(b"0123456789").hexdigest())
    cache.append("wrong", 0, b"xxx")
    cache.accept("ahead", 99, 1, hashlib.sha256(b"a").hexdigest())
    put(ahead=b"b")  # the source is behind what the cache has seen of it
    out = _told(transfer_all(source, cache), "artifact_id", "outcome", "fetched")
    assert out == {
        "big": ("verified", len(big)), "begun": ("verified", len(big) - 60_000), "wrong": ("mismatch", 7), "empty": ("verified", 0),
        "small": ("verified", 3), "ahead": ("Stale", 0),
    }
    for name, data in (("big", big), ("begun", big[::-1]), ("small", b"abc")):
        assert b"".join(bytes(r["bytes"]) for r in cache.read_verified(name).collect()) == data
    assert cache.lookup("begun")["revision"] == cut["revision"] and cache.read_verified("wrong") is None
    source.delete("small")
    put(big=b"new")
    out = _told(transfer_all(source, cache), "artifact_id", "outcome", "fetched")
    assert out == {"big": ("verified", 3), "begun": ("unchanged", 0), "wrong": ("verified", 10), "empty": ("unchanged", 0), "small": ("deleted", 0), "ahead": ("Stale", 0)}
    assert cache.read_verified("small") is None and b"".join(bytes(r["bytes"]) for r in cache.read_verified("big").collect()) == b"new"
    # A merge leaves out what was dropped or superseded and nothing else.
    at = cache.log.snapshot()
    before = _told(cache.index(at), "artifact_id", "revision", "verified", "next")
    rows = cache.log.fold(cache.log.read(at))
    assert rows.filter("kind = 'chunk'").groupBy("artifact_id").count().filter("artifact_id = 'big' AND count > 1").isEmpty()
    cache.log.compact(at, rows)
    assert _told(cache.index(), "artifact_id", "revision", "verified", "next") == before
    only = spark.createDataFrame([("big",)], "artifact_id string")
    assert _told(transfer_all(source, cache, only), "artifact_id", "outcome") == {"big": ("unchanged",)}
    cache.revoke()
    with pytest.raises(Refusal) as e:
        transfer_all(source, cache)
    assert e.value.code == "Revoked"


def _stream_rows(spark, sizes, size=3):
    rows = [(s, p, f"{s}-{p}", bytearray(f"{s}{p}".encode().ljust(size))) for s, n in sizes.items() for p in range(1, n + 1)]
    return spark.createDataFrame(rows, "stream string, position bigint, record_id string, payload binary")


def test_many_streams_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commitlog, "FANIN", 2)
    rows = _stream_rows(spark, {"a": 9, "b": 1, "c": 5, "d": 4, "gap": 6, "big": 3})
    rows = rows.filter("NOT (stream = 'gap' AND position = 3)").withColumn("payload", F.when(F.expr("stream = 'big' AND position = 2"), F.lit(b"x" * 99)).otherwise(F.col("payload")))
    targets = spark.createDataFrame([("a", 4), ("a", 6), ("b", 1), ("c", 1), ("d", 3), ("gap", 1), ("big", 1), ("none", 1)], "stream string, lower_target bigint")
    floors = spark.createDataFrame([("c", 2)], "stream string, floor bigint")
    store = StreamsReplica(spark, f"{tmp_path}/s")
    stopped = hydrate_streams(rows, targets, Limits(2, 100, 50), store, floors)
    assert {(r["stream"], r["refusal"]) for r in stopped.collect()} == {("gap", "Noncontiguous"), ("big", "OversizedRecord")}
    got = {k: v for k, v in _told(store.progress(), "stream", "lower_bound", "live_head", "oldest_available", "generation").items()}
    assert got == {"a": (4, 9, 1, 1), "b": (1, 1, 1, 1), "c": (3, 5, 3, 1), "d": (3, 4, 1, 1), "gap": (5, 6, 1, 1), "big": (3, 3, 1, 1)}
    held = sorted((r["stream"], r["position"]) for r in store.rows().collect())
    assert held == sorted([("a", p) for p in range(4, 10)] + [("b", 1)] + [("c", p) for p in (3, 4, 5)] + [("d", 3), ("d", 4), ("gap", 5), ("gap", 6), ("big", 3)])

    versions = _told(store.progress(), "stream", "version")
    page = lambda *r: spark.createDataFrame(list(r), "stream string, first bigint, last bigint, oldest bigint, expected bigint")
    older = _stream_rows(spark, {"a": 3, "d": 2})
    told = store.install_older(page(("a", 1, 3, 1, versions["a"][0]), ("d", 1, 2, 1, versions["d"][0] - 1), ("new", 1, 1, 1, None)), older)
    assert _told(told, "stream", "refusal") == {"a": (None,), "d": ("Stale",), "new": ("Stale",)}  # the others are installed
    conflict = older.filter("stream = 'd'").unionByName(rows.filter("stream = 'd' AND position = 3").withColumn("payload", F.lit(b"other")))
    told = store.install_older(page(("d", 1, 3, 1, versions["d"][0])), conflict)
    assert _told(told, "stream", "refusal") == {"d": ("ConflictingRecord",)}
    assert _told(store.progress(), "stream", "lower_bound")["a"] == (1,) and store.rows().filter("stream = 'a'").count() == 9

    store.fence_deletions(spark.createDataFrame([("b",)], "stream string"))
    tails = spark.createDataFrame([("b", 1, 1, 1, None), ("c", 6, 6, 3, versions["c"][0])], "stream string, first bigint, watermark bigint, oldest bigint, expected bigint")
    told = store.install_tails(tails, _stream_rows(spark, {"b": 1, "c": 6}).filter("stream = 'b' OR position = 6"))
    assert _told(told, "stream", "refusal") == {"b": ("Deleted",), "c": (None,)}
    assert [r["position"] for r in store.rows().filter("stream IN ('b', 'c')").collect()] == [6]  # a new generation, and a fence
    assert _told(store.progress(), "stream", "generation", "lower_bound")["c"] == (2, 6)


def test_installs_are_planned_anew_when_others_commit(spark, tmp_path):
    store = StreamsReplica(spark, f"{tmp_path}/s")
    tails = lambda s: spark.createDataFrame([(s, 1, 1, 1, None)], "stream string, first bigint, watermark bigint, oldest bigint, expected bigint")
    plain, other = store.log.commit, StreamsReplica(spark, f"{tmp_path}/s")

    def late(at, *rest):
        store.log.commit = plain
        other.install_tails(tails("b"), _stream_rows(spark, {"b": 1}))
        return plain(at, *rest)

    store.log.commit = late
    assert _told(store.install_tails(tails("a"), _stream_rows(spark, {"a": 1})), "stream", "refusal") == {"a": (None,)}
    assert {r["stream"] for r in store.rows().collect()} == {"a", "b"}
    # The same stream, moved meanwhile, is refused.
    assert _told(store.install_tails(tails("b"), _stream_rows(spark, {"b": 1})), "stream", "refusal") == {"b": ("Stale",)}


def test_a_hundred_thousand_pins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pins, "FANIN", 3)
    table = RecordTable(spark, f"{tmp_path}/t", Scope("device-a", "origin", "transcript", "first", "text-v1", "epoch-1"))
    table.append(spark.range(1, 10).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("record_id"), F.lit(b"x").alias("payload")))
    many = spark.range(100_000).select(F.concat(F.lit("h"), "id").alias("holder"), (F.col("id") % 7 + 2).alias("completed"), (F.col("id") % 5 * 10 + 20).alias("expires_at_ms"))
    bad = spark.createDataFrame([("twice", 5, 50), ("twice", 6, 60), ("above", 10, 50), ("past", 5, 10)], "holder string, completed bigint, expires_at_ms bigint")
    told = table.register_pins(many.unionByName(bad), 10)
    assert _told(told.filter("refusal IS NOT NULL"), "holder", "refusal") == {"twice": ("InvalidPlan",), "above": ("PinOutOfRange",), "past": ("Expired",)}
    assert table.pins().count() == 100_000 and len(table.log.snapshot().state["pins"]) == 1  # the state names a run, not the pins
    receipt = table.pin("h7")
    assert receipt == {"holder": "h7", "completed": 2, "expires_at_ms": 40, "revision": 1}
    assert table.prune_with_retention(9, None, 15) == 2
    for now in (21, 22):
        receipt = table.refresh_pin(receipt, receipt["completed"] + 3, now, 900)
    assert len(table.log.snapshot().state["pins"]) == 1  # merged: what has expired or was refreshed is gone
    assert table.pins().count() == 80_000 and table.pin("h7") == receipt and receipt["revision"] == 3
    assert table.prune_with_retention(9, None, 100) == 8 and table.prune_with_retention(9, None, 900) == 9
