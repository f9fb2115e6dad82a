"""Registered queries of validators and durable tables, and their SQL, over whole tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import bindings as B
from tidemark.catalog import _EVENT, _FOLD, _PART, _TURN, _mutations, _part, _size, _state_sql
from tidemark.functions import columns as C
from tidemark.operators import artifacts, catalogue, fixtures, validate
from tidemark.operators.ordering import with_rank
from tidemark.plans import history as history_plans
from tidemark.plans import passes
from tidemark.plans.transfer import transfer_all
from tidemark.schema import ENTRIES, RECORDS, STAGED, Limits, Scope
from tidemark.sources.commitlog import CommitLog
from tidemark.sources.datasource import read_table
from tidemark.sources.epochs import EpochLedger, EpochReplica, Stamped, rows_digest
from tidemark.sources.memory import MemoryAuthorizer
from tidemark.sources.streams import StreamsReplica
from tidemark.sources.tables import ArtifactCache, ArtifactTable, CatalogueTable, RecordTable, ReplicaTable
from tidemark.sources.views import CatalogueView, RecordView
from tidemark.streaming.follow import fold, follow_hints, follow_table
from tidemark.workdir import work_dir

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_SCOPE = Scope("receiver", "origin", "stream", "first", "text-v1", "epoch-1")
_ALLOW = MemoryAuthorizer()


def _register(name: str, sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name], _SQL[name] = f, sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _scratch(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


# --- validators ------------------------------------------------------------

@_register("history_page_refusals", f"""
WITH t AS (SELECT *, max(position) OVER (PARTITION BY conv_id) AS last FROM ({_TURN})),
r AS (SELECT conv_id AS page, position AS ordinal, CASE WHEN conv_id % 5 = 1 AND position = 2 THEN 1 ELSE position END AS position, CASE WHEN conv_id % 5 = 2 AND position <= 2 THEN 'twice' ELSE record_id END AS record_id,
  CAST(strlen(payload) AS BIGINT) AS size, last, NOT (conv_id % 5 = 3 AND position = 1) AS same_scope FROM t),
m AS (SELECT *, sum(size) OVER (PARTITION BY page ORDER BY ordinal) AS total, row_number() OVER (PARTITION BY page, record_id ORDER BY ordinal) > 1 AS repeated, row_number() OVER (PARTITION BY page ORDER BY ordinal) AS place FROM r),
k AS (SELECT *, CASE WHEN NOT same_scope OR repeated THEN 'WrongRecord' WHEN position <> place THEN 'Noncontiguous' WHEN size > 2000 OR total > 4000 THEN 'BoundsExceeded' END AS code FROM m)
SELECT page, CASE WHEN page % 11 = 0 THEN 'InvalidRequest' WHEN count(*) <> max(last) + CASE WHEN page % 7 = 0 THEN 1 ELSE 0 END THEN 'InvalidBoundary' WHEN count(*) > 12 THEN 'BoundsExceeded'
  ELSE arg_min(code, ordinal) FILTER (WHERE code IS NOT NULL) END AS refusal FROM k GROUP BY page""")
def history_page_refusals(spark, sf):
    """Every conversation as one tail, some with a wrong generation or watermark, a gap, a repeated id or a foreign record."""
    c, p = F.col("conv_id"), F.col("position")
    turns = B.turns(spark, sf)
    rows = turns.select(
        c.alias("page"), p.alias("ordinal"), F.when((c % 5 == 1) & (p == 2), 1).otherwise(p).alias("position"),
        F.when((c % 5 == 2) & (p <= 2), "twice").otherwise(F.col("record_id")).alias("record_id"), _size().alias("size"), (~((c % 5 == 3) & (p == 1))).alias("same_scope"),
    )
    last = F.max("position") + F.when(c % 7 == 0, 1).otherwise(0)
    requests = turns.groupBy("conv_id").agg(last.alias("last")).select(
        c.alias("page"), F.when(c % 11 == 0, 0).otherwise(1).alias("generation"), F.lit(1).alias("first"), "last", F.lit(1).alias("oldest"),
        F.lit(12).alias("max_records"), F.lit(4000).alias("max_bytes"), F.lit(2000).alias("max_record_bytes"),
    )
    return validate.history_pages(rows, requests)


@_register("manifest_refusals", f"""WITH {_FOLD}, {_state_sql('c')},
n AS (SELECT entry_id, creation, revision, (row_number() OVER (ORDER BY creation) - 1) // 16 AS page, (row_number() OVER (ORDER BY creation) - 1) % 16 + 1 AS place FROM c),
r AS (SELECT page, CASE WHEN page % 4 = 1 AND place = 3 THEN 99 ELSE place END AS ordinal, entry_id, creation, CASE WHEN page % 4 = 2 AND place = 5 THEN creation - 1 ELSE revision END AS revision FROM n),
o AS (SELECT *, lag(creation) OVER (PARTITION BY page ORDER BY ordinal) AS before, lag(entry_id) OVER (PARTITION BY page ORDER BY ordinal) AS before_id FROM r)
SELECT page, CASE WHEN page % 4 = 3 THEN 'BoundsExceeded' WHEN bool_or(creation <= 0 OR revision < creation OR creation < before OR (creation = before AND entry_id <= before_id)) THEN 'InvalidOrder' END AS refusal
FROM (SELECT *, count(*) OVER (PARTITION BY page) AS n FROM o) GROUP BY page, n HAVING page % 4 <> 3 OR n > 8
UNION ALL SELECT page, CASE WHEN bool_or(creation < before) THEN 'InvalidOrder' END FROM (SELECT *, count(*) OVER (PARTITION BY page) AS n FROM o) WHERE page % 4 = 3 AND n <= 8 GROUP BY page""")
def manifest_refusals(spark, sf):
    """The whole catalogue in manifest pages of 16, some out of order, with a revision before the creation, or longer than was asked for."""
    c = with_rank(catalogue.current(_mutations(spark, sf)).select("entry_id", "creation", "revision"), "creation", "n")
    page, place = F.floor((F.col("n") - 1) / 16), (F.col("n") - 1) % 16 + 1
    rows = c.select(
        page.alias("page"), F.when((page % 4 == 1) & (place == 3), 99).otherwise(place).alias("ordinal"), "entry_id", "creation",
        F.when((page % 4 == 2) & (place == 5), F.col("creation") - 1).otherwise(F.col("revision")).alias("revision"),
    )
    requests = rows.select("page").distinct().select(
        "page", F.lit(0).alias("completed"), F.lit(1 << 60).alias("boundary"), F.lit(1).alias("generation"), F.lit(None).cast("bigint").alias("cursor_creation"),
        F.lit(None).cast("string").alias("cursor_id"), F.when(F.col("page") % 4 == 3, 8).otherwise(16).alias("max_entries"), F.lit(False).alias("has_more"),
    )
    return validate.manifests(rows, requests)


@_register("open_page_refusals", """
SELECT event_id, CASE WHEN head < after THEN 'SourceBehindCheckpoint' WHEN head = after AND records > 0 THEN 'Noncontiguous' WHEN head > after AND records = 0 THEN 'EmptyPage' END AS refusal
FROM (SELECT event_id, user_id % 5 AS after, event_id % 7 AS head, (event_id + user_id) % 3 AS records FROM events)""")
def open_page_refusals(spark, sf):
    e = B.table(spark, sf, "events")
    return e.select("event_id", C.open_page_refusal(F.col("user_id") % 5, F.col("event_id") % 7, (F.col("event_id") + F.col("user_id")) % 3).alias("refusal"))


@_register("resolved_refusals", f"""WITH {_FOLD}, {_state_sql('c')}, {_state_sql('k', _PART.format(2))},
j AS (SELECT c.entry_id, k.creation AS kc, k.revision AS kr, k.deleted AS kd, c.creation + CASE WHEN c.creation % 13 = 5 THEN 1 ELSE 0 END AS cc, CASE WHEN c.creation % 11 = 3 THEN k.revision - 1 ELSE c.revision END AS cr,
  CASE WHEN k.deleted AND c.creation % 2 = 0 THEN false ELSE c.deleted END AS cd, CASE WHEN c.creation % 9 = 1 THEN 5000 ELSE 3 END AS size FROM c JOIN k USING (entry_id))
SELECT entry_id, CASE WHEN kc <> cc OR cr < kr OR (cr = kr AND cd <> kd) THEN 'WrongPayload' WHEN kd AND NOT cd THEN 'DeletionFence' WHEN cd AND size > 0 THEN 'WrongPayload' WHEN size > 4096 THEN 'OversizedEntry' END AS refusal FROM j""")
def resolved_refusals(spark, sf):
    """Descriptors of half the log answered by the values of the whole: some with another creation, an older revision, a fence broken or too many bytes."""
    m = _mutations(spark, sf)
    named = catalogue.as_of(m, _part(spark, sf, 2)).select("entry_id", F.struct("creation", "revision", "deleted").alias("named"))
    both = catalogue.current(m).join(named, "entry_id")
    c = F.col("creation")
    value = F.struct(
        (c + F.when(c % 13 == 5, 1).otherwise(0)).alias("creation"), F.when(c % 11 == 3, F.col("named.revision") - 1).otherwise(F.col("revision")).alias("revision"),
        F.when(F.col("named.deleted") & (c % 2 == 0), False).otherwise(F.col("deleted")).alias("deleted"),
    )
    both = both.withColumns({"value": value, "size": F.when(c % 9 == 1, 5000).otherwise(3)})
    return both.select("entry_id", C.resolved_refusal("named", "value", F.col("size"), 4096).alias("refusal"))


@_register("recovery_enumerate_floors", f"""WITH {_FOLD}, {_state_sql('c')}, {_state_sql('q', _PART.format(4))},
f AS (SELECT entry_id, creation, revision + CASE WHEN creation % 4 = 0 THEN 1000000 ELSE 0 END AS revision FROM q WHERE NOT deleted)
SELECT c.entry_id, CASE WHEN f.creation <> c.creation OR c.revision < f.revision OR (c.revision = f.revision AND c.deleted) THEN 'WrongPayload' END AS refusal FROM c JOIN f USING (entry_id)""")
def recovery_enumerate_floors(spark, sf):
    """Values of an enumeration against the floors of candidates, some of which are above what the source now says."""
    m = _mutations(spark, sf)
    q = catalogue.as_of(m, _part(spark, sf, 4)).filter("NOT deleted")
    floors = q.select("entry_id", F.struct("creation", (F.col("revision") + F.when(F.col("creation") % 4 == 0, 1000000).otherwise(0)).alias("revision"), "deleted").alias("floor"))
    values = catalogue.current(m).select("entry_id", F.struct("creation", "revision", "deleted").alias("value"))
    return values.join(floors, "entry_id").select("entry_id", catalogue.transition_refusal("floor", "value").alias("refusal"))


@_register("recovery_phase_refusals", """
SELECT event_id, CASE WHEN NOT ((phase = 'enumerate' AND completed = 0 AND active IS NOT DISTINCT FROM boundary) OR (phase IN ('reconcile', 'finish') AND active IS NULL AND completed = boundary)) THEN 'InvalidRecovery' END AS refusal
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'enumerate' WHEN 1 THEN 'reconcile' WHEN 2 THEN 'finish' ELSE 'other' END AS phase, event_id % 3 * 5 AS completed, CASE WHEN user_id % 2 = 0 THEN 5 END AS active, 5 AS boundary FROM events)""")
def recovery_phase_refusals(spark, sf):
    k = F.col("event_id")
    phase = F.when(k % 4 == 0, "enumerate").when(k % 4 == 1, "reconcile").when(k % 4 == 2, "finish").otherwise("other")
    return B.table(spark, sf, "events").select("event_id", C.recovery_refusal(phase, k % 3 * 5, F.when(F.col("user_id") % 2 == 0, 5), F.lit(5)).alias("refusal"))


@_register("horizon_refusals", """
SELECT event_id, CASE WHEN version <> 2 THEN 'UnsupportedVersion' WHEN horizon > head THEN 'InvalidHorizon' WHEN horizon < previous THEN 'HorizonRegressed' END AS refusal
FROM (SELECT event_id, 1 + least(event_id % 5, 1) AS version, event_id % 11 AS horizon, user_id % 13 AS head, user_id % 6 AS previous FROM events)""")
def horizon_refusals(spark, sf):
    k, u = F.col("event_id"), F.col("user_id")
    return B.table(spark, sf, "events").select("event_id", C.horizon_refusal(1 + F.least(k % 5, F.lit(1)), k % 11, u % 13, u % 6).alias("refusal"))


@_register("artifact_manifest_refusals", """
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'Foreign' WHEN revision <= 0 THEN 'InvalidRevision' WHEN saved IS NULL THEN NULL WHEN saved_state = 'deleted' AND state <> 'deleted' THEN 'Fenced' WHEN revision < saved THEN 'Stale' WHEN revision = saved AND state <> saved_state THEN 'Conflict' END AS refusal
FROM (SELECT doc_id, doc_id % 5 AS revision, CASE WHEN doc_id % 4 = 0 THEN 'deleted' ELSE sha256(text) END AS state, CASE WHEN doc_id % 6 <> 0 THEN 2 END AS saved, CASE WHEN doc_id % 3 = 0 THEN 'deleted' WHEN doc_id % 7 = 0 THEN 'other' ELSE sha256(text) END AS saved_state FROM documents)""")
def artifact_manifest_refusals(spark, sf):
    k, digest = F.col("artifact_id"), F.col("digest")
    state, saved_state = F.when(k % 4 == 0, "deleted").otherwise(digest), F.when(k % 3 == 0, "deleted").when(k % 7 == 0, "other").otherwise(digest)
    refusal = artifacts.manifest_refusal(k % 17 != 0, k % 5, state, F.when(k % 6 != 0, 2), saved_state)
    return artifacts.identities(B.artifacts(spark, sf)).select(k.alias("doc_id"), refusal.alias("refusal"))


@_register("artifact_chunk_refusals", """
SELECT doc_id, o AS "offset", CASE WHEN doc_id % 13 = 0 OR o >= size THEN 'InvalidRequest' WHEN doc_id % 11 = 3 THEN 'WrongRequest' WHEN least(4096, size - o) - CASE WHEN doc_id % 7 = 2 THEN 1 ELSE 0 END <> least(4096, size - o) THEN 'WrongLength' END AS refusal
FROM (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size FROM documents), unnest(range(0, size + 4096, 4096)) AS r(o)""")
def artifact_chunk_refusals(spark, sf):
    """Chunk replies of every artifact, one behind its end, some of dead artifacts, for another request, or a byte short."""
    k, size, offset = F.col("artifact_id"), F.col("length"), F.col("offset")
    rows = artifacts.identities(B.artifacts(spark, sf)).withColumn("offset", F.explode(F.sequence(F.lit(0).cast("bigint"), size + 4095, F.lit(4096).cast("bigint"))))
    got = F.least(F.lit(4096), size - offset) - F.when(k % 7 == 2, 1).otherwise(0)
    return rows.select(k.alias("doc_id"), "offset", artifacts.chunk_refusal(offset, F.lit(4096), size, got, k % 11 != 3, k % 13 != 0).alias("refusal"))


@_register("access_decisions", """
SELECT event_id, CASE decision WHEN 'Allowed' THEN CASE WHEN user_id % 3 = 0 THEN 'WrongAccessScope' END WHEN 'Denied' THEN 'Denied' WHEN 'IdentityChanged' THEN 'WrongAccessScope' WHEN 'InvalidResponse' THEN 'InvalidAccessResponse' ELSE 'Unverifiable' END AS refusal
FROM (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN 'Allowed' WHEN 1 THEN 'Denied' WHEN 2 THEN 'IdentityChanged' WHEN 3 THEN 'InvalidResponse' ELSE 'Unverifiable' END AS decision FROM events)""")
def access_decisions(spark, sf):
    k = F.col("event_id") % 5
    decision = F.when(k == 0, "Allowed").when(k == 1, "Denied").when(k == 2, "IdentityChanged").when(k == 3, "InvalidResponse").otherwise("Unverifiable")
    return B.table(spark, sf, "events").select("event_id", C.access_refusal(decision, F.col("user_id") % 3 != 0).alias("refusal"))


# --- durable tables --------------------------------------------------------

def _facts(spark, sf, low: float = 0.0, high: float = 1.0) -> tuple[DataFrame, int]:
    """Events between two shares of the stream as records to append, and the head of the whole."""
    e = B.event_records(spark, sf)
    head = e.head().first()["head"] or 0
    rows = e.between(int(head * low), int(head * high))
    return rows.select(F.col("position").alias("seq"), "record_id", F.col("payload").cast("binary").alias("payload")), head


@_register("record_append_overlapping", f"SELECT count(*) AS records, count(DISTINCT position) AS positions, max(position) AS head, CAST(sum(strlen(payload)) AS BIGINT) AS bytes, max(position) // 2 AS floor FROM ({_EVENT})")
def record_append_overlapping(spark, sf):
    """Two batches that overlap in the middle of the stream, then a floor that prunes half of what can be read; rows stay."""
    source = RecordTable(spark, _scratch(spark, "records"), _SCOPE)
    for low, high in ((0.0, 0.6), (0.4, 1.0)):
        head = source.append(_facts(spark, sf, low, high)[0])
    floor = source.prune_through(head // 2)
    seen = source.log.read().agg(F.count("*").alias("records"), F.count_distinct("position").alias("positions"), F.max("position").alias("head"), F.sum(_size()).alias("bytes"))
    return seen.withColumn("floor", F.lit(floor).cast("bigint"))


@_register("record_prune_guarded", """
WITH h AS (SELECT max(event_id) + 1 AS head FROM events), p AS (SELECT user_id % 40 AS k, max(event_id) + 1 AS completed FROM events GROUP BY ALL)
SELECT (SELECT min(completed) FROM p WHERE k % 2 = 0) AS held, head - 1 AS released, head - 1 AS forced FROM h""")
def record_prune_guarded(spark, sf):
    """Forty receivers pin what they have read, those with odd numbers for a moment only; the floor yields to live pins until they expire."""
    source = RecordTable(spark, _scratch(spark, "pins"), _SCOPE)
    head = source.append(_facts(spark, sf)[0])
    held = B.table(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("k")).agg((F.max("event_id") + 1).alias("completed"))
    pins = held.select(F.concat(F.lit("r"), F.col("k").cast("string")).alias("holder"), "completed", F.when(F.col("k") % 2 == 1, 20).otherwise(90).cast("bigint").alias("expires_at_ms"))
    source.register_pins(pins, 10)
    reopened = RecordTable(spark, source.log.path, _SCOPE)
    floors = [reopened.prune_with_retention(head - 1, None, 50), reopened.prune_with_retention(head - 1, None, 100), reopened.prune_with_retention(head - 1, head - 1, 100)]
    return spark.createDataFrame([tuple(floors)], "held bigint, released bigint, forced bigint")


@_register("record_pins_of_all_users", """
WITH h AS (SELECT max(event_id) + 1 AS head FROM events), p AS (SELECT user_id, max(event_id) + 1 AS completed FROM events GROUP BY ALL)
SELECT 'u' || CAST(user_id AS VARCHAR) AS holder, completed, CAST(CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS revision, CASE WHEN user_id % 3 <> 0 THEN 'Exists' END AS again,
  (SELECT min(completed) FROM p WHERE user_id % 3 <> 0) AS held, (SELECT min(completed) FROM p) AS held_again, head - 1 AS released FROM p, h""")
def record_pins_of_all_users(spark, sf):
    """Every user pins what they have read, in one commit, and again once every third pin has expired; the floor yields to the live ones of each moment."""
    source = RecordTable(spark, _scratch(spark, "pins"), _SCOPE)
    head = source.append(_facts(spark, sf)[0])
    read = B.table(spark, sf, "events").groupBy("user_id").agg((F.max("event_id") + 1).alias("completed"))
    pins = read.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("holder"), "completed", F.when(F.col("user_id") % 3 == 0, 20).otherwise(90).cast("bigint").alias("expires_at_ms"))
    source.register_pins(pins, 10)
    low = source.pins().filter("expires_at_ms > 50").agg(F.min("completed")).first()[0]
    again = source.register_pins(pins.withColumn("expires_at_ms", F.lit(95).cast("bigint")), 50).select("holder", F.col("refusal").alias("again"))
    floors = {"held": low, "held_again": source.prune_with_retention(head - 1, None, 60), "released": source.prune_with_retention(head - 1, None, 100)}
    rows = source.pins().join(again, "holder").select("holder", "completed", "revision", "again")
    return rows.withColumns({k: F.lit(v).cast("bigint") for k, v in floors.items()})


@_register("replica_apply_and_replay", f"SELECT count(*) AS records, max(position) AS checkpoint, true AS replayed, CAST(7 AS BIGINT) AS epoch FROM ({_EVENT})")
def replica_apply_and_replay(spark, sf):
    """Two plans of one epoch applied in order, the first of them again, which changes nothing; the epoch's floor is saved with them."""
    store = ReplicaTable(spark, _scratch(spark, "replica"))
    ledger = EpochLedger(spark, _scratch(spark, "ledger"))
    for i in range(7):
        epoch = ledger.claim("auth", i or None)
    fenced = EpochReplica(store, "auth")
    fenced.observe(Stamped("auth", _SCOPE, epoch, None))
    at = 0
    plans = [_facts(spark, sf, a, b)[0].withColumnRenamed("seq", "position") for a, b in ((0.0, 0.5), (0.5, 1.0))]
    for plan in plans:
        at = fenced.apply(Stamped("auth", _SCOPE, epoch, plan), at)
    replayed = ReplicaTable(spark, store.log.path).apply(_SCOPE, 0, plans[0]) == at
    seen = store.log.read().agg(F.count("*").alias("records"))
    return seen.select("records", F.lit(at).cast("bigint").alias("checkpoint"), F.lit(replayed).alias("replayed"), F.lit(EpochReplica(store, "auth").floor).cast("bigint").alias("epoch"))


@_register("history_install", f"""
WITH h AS (SELECT max(position) AS head FROM ({_EVENT}))
SELECT position, record_id, payload, head AS live_head, head - 35 AS lower_bound FROM ({_EVENT}), h WHERE position > head - 36""")
def history_install(spark, sf):
    """A tail of 12 records and two older pages of 12 of the whole stream, fetched, validated and installed."""
    source, view = RecordTable(spark, _scratch(spark, "source"), _SCOPE), ReplicaTable(spark, _scratch(spark, "view"))
    source.append(_facts(spark, sf)[0])
    limits = Limits(12, 1 << 20, 1 << 19)
    history_plans.fetch_tail(_SCOPE, limits, _ALLOW, source, view)
    for _ in range(2):
        progress = history_plans.fetch_older(_SCOPE, limits, _ALLOW, source, view)
    rows = view.log.read().select("position", "record_id", F.col("payload").cast("string").alias("payload"))
    return rows.withColumns({"live_head": F.lit(progress["live_head"]).cast("bigint"), "lower_bound": F.lit(progress["lower_bound"]).cast("bigint")})


@_register("history_from_view", f"""
WITH h AS (SELECT max(position) AS head FROM ({_EVENT}))
SELECT position, record_id, payload, head AS live_head, head - 119 AS lower_bound FROM ({_EVENT}), h WHERE position > head - 120""")
def history_from_view(spark, sf):
    """A tail and two older pages of 40 records, read from the table of events through the port, and installed."""
    source, view = RecordView(B.event_records(spark, sf), _SCOPE), ReplicaTable(spark, _scratch(spark, "view"))
    limits = Limits(40, 1 << 20, 1 << 19)
    progress = history_plans.fetch_tail(_SCOPE, limits, _ALLOW, source, view)
    for _ in range(2):
        progress = history_plans.fetch_older(_SCOPE, limits, _ALLOW, source, view)
    rows = view.log.read().select("position", "record_id", F.col("payload").cast("string").alias("payload"))
    return rows.withColumns({"live_head": F.lit(progress["live_head"]).cast("bigint"), "lower_bound": F.lit(progress["lower_bound"]).cast("bigint")})


@_register("epoch_page_digests", f"""
SELECT (position - 1) // 256 AS page, count(*) AS records,
  sha256(string_agg(position || ':' || sha256(record_id) || ':' || sha256(payload), chr(10) ORDER BY position)) AS digest
FROM ({_EVENT}) GROUP BY 1""")
def epoch_page_digests(spark, sf):
    """What a seal says about the records of each page of 256, over the whole stream."""
    rows = B.event_records(spark, sf).all().withColumn("payload", F.col("payload").cast("binary"))
    return rows.groupBy(F.floor((F.col("position") - 1) / 256).alias("page")).agg(F.count("*").alias("records"), rows_digest().alias("digest"))


def _source(spark, sf) -> CatalogueTable:
    """The whole mutation log in two batches."""
    table = CatalogueTable(spark, _scratch(spark, "catalogue"), _SCOPE)
    log = B.mutation_log(spark, sf).withColumn("payload", F.col("payload").cast("binary"))
    middle = _part(spark, sf, 2)
    for part in (log.filter(F.col("seq") < middle), log.filter(F.col("seq") >= middle)):
        table.apply(part)
    return table


def _told(entries: DataFrame) -> DataFrame:
    return entries.select("entry_id", "creation", "revision", "deleted", F.col("payload").cast("string").alias("payload"))


@_register("catalogue_source_batches", f"WITH {_FOLD}, {_state_sql('c')} SELECT entry_id, creation, revision, deleted, payload FROM c")
def catalogue_source_batches(spark, sf):
    """A catalogue built of two batches, each written as what it changes, equals the fold of the whole log."""
    return _told(_source(spark, sf).entries())


@_register("retention_collect_guarded", f"""WITH {_FOLD}, {_state_sql('c')}, h AS (SELECT max(revision) AS head FROM m),
z AS (SELECT head // 2 AS held, head - 1 AS free FROM h)
SELECT entry_id, revision, NOT (deleted AND revision < free) AS visible, held AS first_horizon, free AS horizon FROM c, z WHERE deleted""")
def retention_collect_guarded(spark, sf):
    """The horizon yields to a live pin at half of the head, then, once it has expired, hides all markers below the last revision."""
    table = _source(spark, sf)
    head = table.head()
    receipt = table.register_pin("slow", head // 4, 1, 50)
    table.refresh_pin(receipt, head // 2, 10, 60)
    first = table.collect_with_retention(head - 1, None, 20)
    second = CatalogueTable(spark, table.log.path, _SCOPE).collect_with_retention(head - 1, None, 60)
    rows = table.entries().filter("deleted").select("entry_id", "revision", "visible")
    return rows.withColumns({"first_horizon": F.lit(first).cast("bigint"), "horizon": F.lit(second).cast("bigint")})


def _cache(spark) -> passes.CatalogueCache:
    return passes.CatalogueCache(CommitLog(spark, _scratch(spark, "cache"), "catalogue-cache", ENTRIES))


@_register("catalogue_pass_cached", f"WITH {_FOLD}, {_state_sql('c')} SELECT entry_id, creation, revision, deleted, payload FROM c")
def catalogue_pass_cached(spark, sf):
    """A finite pass over the whole catalogue in pages of 256 at most, each validated; those of a round are staged in one plan and committed with the cursor of the last."""
    table, cache = _source(spark, sf), _cache(spark)
    going = passes.begin_or_resume(_SCOPE, _ALLOW, table, cache)
    while going and going.active:
        going = passes.apply_pages(going, 256, _ALLOW, table, cache)
    return _told(cache.entries())


@_register("catalogue_pass_view", f"WITH {_FOLD}, {_state_sql('c')} SELECT entry_id, creation, revision, deleted, payload FROM c")
def catalogue_pass_view(spark, sf):
    """The same pass over a plain table of current states, written once in the order of creation and read by ranges of it."""
    states = catalogue.current(_mutations(spark, sf)).withColumns({"payload": F.col("payload").cast("binary"), "visible": F.lit(True)})
    path = _scratch(spark, "states")
    states.repartitionByRange("creation").sortWithinPartitions("creation").write.parquet(path)
    table = spark.read.schema(states.schema).parquet(path)
    head = table.agg(F.coalesce(F.max("revision"), F.lit(0))).first()[0]
    source, cache = CatalogueView(spark, table, _SCOPE, head), _cache(spark)
    going = passes.begin_or_resume(_SCOPE, _ALLOW, source, cache)
    while going and going.active:
        going = passes.apply_pages(going, 256, _ALLOW, source, cache)
    return _told(cache.entries())


@_register("catalogue_recovered", f"WITH {_FOLD}, {_state_sql('c')} SELECT entry_id, creation, revision, deleted, payload FROM c")
def catalogue_recovered(spark, sf):
    """A fresh receiver enumerates the source, then starts over with what it holds as candidates; every step reopens the cache from its log."""
    table, cache = _source(spark, sf), _cache(spark)
    going, rest = passes.start_fresh_recovery(_SCOPE, _ALLOW, table, cache)
    while going:
        going, rest = passes.step_recovery(going, rest, 256, _ALLOW, table, cache, pages=passes.PAGES)
    passes.start_recovery(_SCOPE, table.head(), _ALLOW, cache)
    while going := passes.CatalogueCache(CommitLog(spark, cache.log.path, "catalogue-cache", ENTRIES)).recovery():
        passes.step_recovery(going, rest, 256, _ALLOW, table, cache, pages=passes.PAGES)
    return _told(cache.entries())


@_register("artifact_source_state", """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS artifact_id, doc_id, text FROM documents), last AS (SELECT max(doc_id) AS top FROM d)
SELECT artifact_id, doc_id = top AS deleted, CAST(CASE WHEN doc_id = top THEN 0 WHEN doc_id % 10 = 0 THEN strlen(text) + 1 ELSE strlen(text) END AS BIGINT) AS length,
  CASE WHEN doc_id = top THEN '' WHEN doc_id % 10 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS digest,
  CASE WHEN doc_id % 10 = 0 AND doc_id = top THEN 'fenced' WHEN doc_id % 10 = 0 THEN 'accepted' WHEN doc_id = top THEN 'fenced' ELSE 'quiet' END AS outcome FROM d, last""")
def artifact_source_state(spark, sf):
    """All documents as artifacts, the last one deleted, then all again with every tenth changed: quiet, accepted or fenced."""
    source = ArtifactTable(spark, _scratch(spark, "artifacts"))
    whole = B.artifacts(spark, sf).withColumn("artifact_id", F.col("artifact_id").cast("string"))
    source.upsert(whole)
    source.delete(str(B.table(spark, sf, "documents").agg(F.max("doc_id")).first()[0]))
    changed = F.when(F.col("artifact_id").cast("bigint") % 10 == 0, F.concat("payload", F.lit(b"!"))).otherwise(F.col("payload"))
    told = source.upsert(whole.withColumn("payload", changed))
    return source.manifests().join(told, "artifact_id").select("artifact_id", "deleted", "length", "digest", "outcome")


@_register("catalogue_retired_in_bulk", f"""WITH {_FOLD}, {_state_sql('c')}, h AS (SELECT max(revision) AS head FROM m)
SELECT entry_id, creation, revision, deleted AND revision < head AS retired, least(2, (SELECT count(*) FROM c, h WHERE deleted AND revision < head)) AS first_batch FROM c, h""")
def catalogue_retired_in_bulk(spark, sf):
    """All markers below the last revision, hidden by two collections, become proofs: a batch of two, then all others at once."""
    table = _source(spark, sf)
    for horizon in (table.head() // 2, table.head()):
        table.collect(horizon)
    first = table.compact_retired(2)
    table.compact_all_retired()
    rows = table.entries().select("entry_id", "creation", "revision", F.lit(False).alias("retired")).unionByName(table.proofs().withColumn("retired", F.lit(True)))
    return rows.withColumn("first_batch", F.lit(first).cast("bigint"))


def _arrive(rows: DataFrame, folder: str) -> None:
    """A file of a stream; files are read in the order in which they arrived."""
    rows.coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)


def _mark(spark: SparkSession, log: DataFrame, seq: int) -> DataFrame:
    return spark.range(1).select(F.lit(seq).cast("bigint").alias("seq"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema if f.name != "seq"]).select(*log.columns)


def _sixths(spark, sf) -> tuple[DataFrame, int]:
    """The mutation log with the sixth of its range that each row is in, and how long a sixth is."""
    log = B.mutation_log(spark, sf).withColumn("payload", F.col("payload").cast("binary"))
    sixth = (log.agg(F.max("seq")).first()[0] or 0) // 6 + 1
    return log.withColumn("part", F.floor(F.col("seq") / sixth)), sixth


@_register("catalogue_stream_fold", f"WITH {_FOLD}, {_state_sql('c')} SELECT entry_id, creation, revision, deleted, payload FROM c")
def catalogue_stream_fold(spark, sf):
    """The mutation log arrives as files of a stream, sixths of it out of order, and is folded key by key in one micro-batch for each file."""
    base = _scratch(spark, "fold")
    log, sixth = _sixths(spark, sf)
    for parts in ([1], [0, 3], [2, 5], [4]):
        _arrive(log.filter(F.col("part").isin(parts)).drop("part"), f"{base}/in")
    _arrive(_mark(spark, log.drop("part"), 9 * sixth), f"{base}/in")
    table = CatalogueTable(spark, f"{base}/catalogue", _SCOPE)
    for _ in range(2):  # the second run finds nothing new
        fold(spark, f"{base}/in", log.drop("part").schema, table, f"{base}/progress", 2 * sixth, max_files=1)
    return _told(table.entries())


@_register("catalogue_stream_refusals", "SELECT event_id AS seq, 'u' || CAST(user_id AS VARCHAR) AS entry_id, 'Stale' AS refusal FROM events WHERE event_id // ((SELECT max(event_id) FROM events) // 6 + 1) = 0")
def catalogue_stream_refusals(spark, sf):
    """The first sixth of the mutation log arrives after the watermark has passed it: each of its mutations is refused, none is folded."""
    base = _scratch(spark, "late")
    log, sixth = _sixths(spark, sf)
    for parts in ([1, 2, 3], [4, 5], [0]):
        _arrive(log.filter(F.col("part").isin(parts)).drop("part"), f"{base}/in")
    table = CatalogueTable(spark, f"{base}/catalogue", _SCOPE)
    fold(spark, f"{base}/in", log.drop("part").schema, table, f"{base}/progress", sixth, max_files=1, refused=f"{base}/refused")
    return spark.read.parquet(f"{base}/refused").select("seq", "entry_id", "refusal")


@_register("record_source_stream", _EVENT)
def record_source_stream(spark, sf):
    """A record table as a stream: four runs, two after a commit each, one after two commits, one with nothing new."""
    base = _scratch(spark, "source")
    source = RecordTable(spark, f"{base}/records", _SCOPE)
    replica = CommitLog(spark, f"{base}/replica", "record-copy", RECORDS, zone="position")
    for spans in ([(0.0, 0.3)], [(0.2, 0.5)], [(0.5, 0.8), (0.7, 1.0)], []):
        for low, high in spans:
            source.append(_facts(spark, sf, low, high)[0])
        follow_table(spark, source.log.kind, source.log.path, replica, f"{base}/progress")
    return replica.read().select("position", "record_id", F.col("payload").cast("string").alias("payload"))


@_register("record_source_range", f"""
WITH e AS ({_EVENT}), h AS (SELECT max(position) AS head FROM e)
SELECT position // 1000 AS block, count(*) AS records, min(position) AS first, max(position) AS last FROM e, h WHERE position > head // 3 AND position <= 2 * head // 3 GROUP BY ALL""")
def record_source_range(spark, sf):
    """The middle third of a record table: the filter on the position chooses the files of the data source, and positions alone are read."""
    source = RecordTable(spark, _scratch(spark, "source"), _SCOPE)
    for low, high in ((0.0, 0.6), (0.4, 1.0)):
        head = source.append(_facts(spark, sf, low, high)[0])
    rows = read_table(spark, source.log.kind, source.log.path, columns="position")
    rows = rows.filter((F.col("position") > head // 3) & (F.col("position") <= 2 * head // 3))
    return rows.groupBy(F.floor(F.col("position") / 1000).alias("block")).agg(F.count("*").alias("records"), F.min("position").alias("first"), F.max("position").alias("last"))


@_register("catalogue_source_stream", f"WITH {_FOLD}, {_state_sql('c')} SELECT entry_id, creation, revision, deleted, payload FROM c")
def catalogue_source_stream(spark, sf):
    """A catalogue as a stream of states by revision: a copy that follows it commit by commit, keeping the newest, ends with the same entries."""
    base = _scratch(spark, "source")
    source = CatalogueTable(spark, f"{base}/catalogue", _SCOPE)
    copy = CommitLog(spark, f"{base}/copy", "catalogue-copy", source.log.schema, zone="creation", top="revision", fold=source.log.fold)
    log = B.mutation_log(spark, sf).withColumn("payload", F.col("payload").cast("binary"))
    third = (log.agg(F.max("seq")).first()[0] or 0) // 3 + 1
    for k in range(3):
        source.apply(log.filter(F.floor(F.col("seq") / third) == k))
        follow_table(spark, source.log.kind, source.log.path, copy, f"{base}/progress")
    return _told(copy.fold(copy.read()))


@_register("hint_stream", """
WITH n AS (SELECT max(event_id) AS top FROM events),
e AS (SELECT CAST(user_id % 20 AS VARCHAR) AS stream, event_id * 7919 % 10007 AS head, ts, CASE WHEN event_id % 10 = 0 THEN 3 WHEN event_id < top * 3 // 4 THEN 1 ELSE 2 END AS file FROM events, n),
w AS (SELECT max(ts) FILTER (WHERE file = 1) - INTERVAL 2 HOUR AS late, max(ts) - INTERVAL 2 HOUR AS closed FROM e),
h AS (SELECT stream, CAST(ts AS DATE) AS day, max(head) AS head, count(*) AS hints FROM e, w WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= closed AND NOT (file = 3 AND CAST(ts AS DATE) + INTERVAL 1 DAY <= late) GROUP BY ALL)
SELECT stream, CAST(date_diff('day', DATE '1970-01-01', day) AS BIGINT) AS day, head, hints FROM h
QUALIFY head > coalesce(max(head) OVER (PARTITION BY stream ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)""")
def hint_stream(spark, sf):
    """Hints of twenty streams by day: only heads above all before, in closed windows; a tenth of the hints comes last, and those of closed days are dropped."""
    base = _scratch(spark, "hints")
    events = B.table(spark, sf, "events")
    top = events.agg(F.max("event_id")).first()[0] or 0
    file = F.when(F.col("event_id") % 10 == 0, 3).when(F.col("event_id") < top * 3 // 4, 1).otherwise(2)
    ts = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")))  # in any time zone of the session
    hints = events.select((F.col("user_id") % 20).cast("string").alias("stream"), (F.col("event_id") * 7919 % 10007).alias("head"), ts.alias("ts"), file.alias("file"))
    for k in (1, 2, 3):
        _arrive(hints.filter(F.col("file") == k).drop("file"), f"{base}/in")
    follow_hints(spark, f"{base}/in", hints.drop("file").schema, f"{base}/out", f"{base}/progress", "stream", "head", "ts", "1 day", "2 hours", max_files=1)
    days = F.floor(F.unix_micros("opened") / 86_400_000_000).cast("bigint")
    return spark.read.parquet(f"{base}/out").select("stream", days.alias("day"), "head", "hints")


@_register("artifact_transfer_batch", """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS artifact_id, doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n FROM documents), top AS (SELECT max(doc_id) AS top FROM d)
SELECT artifact_id, sha256(CASE WHEN doc_id % 13 = 1 THEN text || '!' ELSE text END) AS digest, CAST(n + CASE WHEN doc_id % 13 = 1 THEN 1 ELSE 0 END AS BIGINT) AS length,
  CASE WHEN doc_id = top THEN 'deleted' WHEN doc_id % 11 = 3 AND n > 4 THEN 'mismatch' ELSE 'verified' END AS first,
  CAST(CASE WHEN doc_id = top THEN 0 WHEN doc_id % 11 = 3 OR doc_id % 7 = 2 THEN greatest(n - 4, 0) ELSE n END AS BIGINT) AS first_bytes,
  CASE WHEN doc_id = top THEN 'deleted' WHEN doc_id % 13 = 1 OR doc_id % 11 = 3 AND n > 4 THEN 'verified' ELSE 'unchanged' END AS second FROM d, top WHERE doc_id <> top""")
def artifact_transfer_batch(spark, sf):
    """All documents as artifacts, some with their first four bytes staged already, some with wrong ones: one job for all of them; then every thirteenth has changed and what failed is fetched anew.

    Texts of four bytes at most are staged whole, and none of them wrong.
    """
    source, cache = ArtifactTable(spark, _scratch(spark, "artifacts")), ArtifactCache(spark, _scratch(spark, "cache"))
    whole = B.artifacts(spark, sf).withColumn("artifact_id", F.col("artifact_id").cast("string"))
    source.upsert(whole)
    source.delete(str(B.table(spark, sf, "documents").agg(F.max("doc_id")).first()[0]))
    k = F.col("artifact_id").cast("bigint")
    begun = source.manifests().filter(((k % 11 == 3) | (k % 7 == 2)) & (F.col("length") > 0)).join(whole, "artifact_id")
    first = F.when((k % 11 == 3) & (F.col("length") > 4), F.lit(b"\x00\x01\x02\x03")).otherwise(F.substring("payload", 1, 4))
    marks = {"version": F.lit(1).cast("bigint"), "offset": F.lit(None).cast("bigint"), "bytes": F.lit(None).cast("binary")}
    manifests = begun.withColumns(marks).withColumn("kind", F.lit("manifest"))
    chunks = begun.withColumns(marks | {"offset": F.lit(0).cast("bigint"), "bytes": first}).withColumn("kind", F.lit("chunk"))
    cache.log.commit(cache.log.snapshot(), {}, manifests.unionByName(chunks).select(*[f.name for f in STAGED]))
    told = transfer_all(source, cache).select("artifact_id", F.col("outcome").alias("first"), F.col("fetched").alias("first_bytes"))
    source.upsert(whole.filter(k % 13 == 1).withColumn("payload", F.concat("payload", F.lit(b"!"))))
    again = transfer_all(source, cache).select("artifact_id", F.col("outcome").alias("second"))
    held = cache.index().filter("verified").select("artifact_id", "digest", "length")
    return held.join(told, "artifact_id").join(again, "artifact_id")


@_register("history_streams_hydrated", """
WITH h AS (SELECT conv_id, max(turn) + 1 AS head, min(turn) + 1 AS low FROM conversations GROUP BY conv_id), t AS (SELECT *, greatest(low, head - 1) AS tail, conv_id % 4 + 1 AS target FROM h),
b AS (SELECT *, CASE WHEN tail <= target THEN tail ELSE greatest(1, tail - 2 * CAST(ceil((tail - target) / 2.0) AS BIGINT)) END AS lower_bound FROM t)
SELECT CAST(b.conv_id AS VARCHAR) AS stream, head AS live_head, lower_bound, c.turn + 1 AS position, coalesce(c.text, '') AS payload FROM b JOIN conversations c ON c.conv_id = b.conv_id AND c.turn + 1 >= lower_bound""")
def history_streams_hydrated(spark, sf):
    """All conversations at once: a tail of two turns each, then pages of two until each has reached a target of its own."""
    turns = B.turns(spark, sf).select(F.col("conv_id").cast("string").alias("stream"), "position", "record_id", F.col("payload").cast("binary").alias("payload"))
    targets = turns.select("stream", (F.col("stream").cast("bigint") % 4 + 1).alias("lower_target")).distinct()
    store = StreamsReplica(spark, _scratch(spark, "streams"))
    history_plans.hydrate_streams(turns, targets, Limits(2, 1 << 20, 1 << 19), store)
    rows = store.rows().join(store.progress().select("stream", "live_head", "lower_bound"), "stream")
    return rows.select("stream", "live_head", "lower_bound", "position", F.col("payload").cast("string").alias("payload"))


@_register("catalogue_churn", """
WITH n AS (SELECT count(*) AS n FROM documents), i AS (SELECT r AS id FROM n, unnest(range(0, n)) AS u(r)),
l AS (SELECT id, id AS seq, false AS del, 'created' AS payload FROM i UNION ALL SELECT id, id + n, false, 'changed' FROM i, n WHERE id % 7 = 0 UNION ALL SELECT id, id + 2 * n, true, NULL FROM i, n WHERE id // 100 % 4 = 3),
m AS (SELECT *, row_number() OVER (ORDER BY seq) AS revision FROM l)
SELECT 'entry-' || lpad(CAST(id AS VARCHAR), 12, '0') AS entry_id, min(revision) AS creation, max(revision) AS revision, bool_or(del) AS deleted, CASE WHEN NOT bool_or(del) THEN arg_max(payload, revision) END AS payload FROM m GROUP BY id""")
def catalogue_churn(spark, sf):
    """The churn fixture with as many entries as there are documents, folded."""
    entries = B.table(spark, sf, "documents").count()
    return _told(catalogue.current(catalogue.accepted(fixtures.churn(spark, entries, 7))))


@_register("record_read_counters", f"SELECT count(*) AS rows, CAST(sum(strlen(payload)) AS BIGINT) AS bytes, CAST(max(strlen(payload)) AS BIGINT) AS largest FROM ({_EVENT})")
def record_read_counters(spark, sf):
    rows = B.event_records(spark, sf).all().withColumn("size", _size())
    seen = fixtures.counted(rows, "size", lambda df: df.write.format("noop").mode("overwrite").save())
    return spark.createDataFrame([(seen["rows"], seen["bytes"], seen["largest"])], "rows bigint, bytes bigint, largest bigint")


@_register("checked_positions", """
SELECT event_id, try_cast(CAST(event_id AS HUGEINT) + 9223372036854775307 AS BIGINT) AS position, CASE WHEN CAST(event_id AS HUGEINT) + 9223372036854775307 > 9223372036854775807 THEN 'PositionOverflow' END AS refusal FROM events""")
def checked_positions(spark, sf):
    total, refusal = C.checked_add(F.col("event_id"), F.lit(9223372036854775307))
    return B.table(spark, sf, "events").select("event_id", total.alias("position"), refusal.alias("refusal"))
