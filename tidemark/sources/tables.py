"""Durable sources and replicas on the commit log: records, histories, catalogues, artifacts."""

from __future__ import annotations

import functools
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidemark.operators import artifacts, catalogue, history, records, retention
from tidemark.operators.ordering import with_rank
from tidemark.schema import ARTIFACTS, ENTRIES, MAX_CHUNK_BYTES, MAX_COMPACTION_BATCH, PROOFS, RECORDS, STAGED, Limits, PageRequest, Refusal, Scope, SourceHead
from tidemark.sources.commitlog import CommitLog, Snapshot
from tidemark.sources.idindex import IdIndex, digest
from tidemark.sources.pins import PinRuns, batch_refusals


class _Pinned:
    """Durable pins of a source: leases with receipts, committed with the state that they hold back."""

    FLOOR = "floor"

    def _runs(self, at: Snapshot) -> PinRuns:
        return PinRuns(self.log, at.state.get("pins", []))

    def _held(self, at: Snapshot, *pins: dict | None) -> dict:
        """The state as the rules of retention see it, with these pins."""
        state = self._state(at)
        return state | {"floor": state[self.FLOOR], "pins": {p["holder"]: p for p in pins if p}}

    def _pinned(self, at: Snapshot, held: dict, holder: str) -> dict:
        pin = held["pins"][holder]
        row = self.spark.createDataFrame([tuple(pin[c] for c in ("holder", "completed", "expires_at_ms", "revision"))], "holder string, completed bigint, expires_at_ms bigint, revision bigint")
        self.log.commit(at, self._state(at) | {"now_ms": held["now_ms"], "pins": self._runs(at).added(row.coalesce(1), held["now_ms"])})
        return pin

    def register_pin(self, holder: str, completed: int, now_ms: int, expires_at_ms: int) -> dict:
        at = self.log.snapshot()
        return self._pinned(at, retention.register(self._held(at, self._runs(at).find(holder)), holder, completed, now_ms, expires_at_ms), holder)

    def register_pins(self, incoming: DataFrame, now_ms: int) -> DataFrame:
        """Register many pins (``holder``, ``completed``, ``expires_at_ms``) in one commit; returns them with ``revision`` and ``refusal``.

        Those that are refused do not keep the others out.
        """
        at = self.log.snapshot()
        held = retention.advance(self._held(at), now_ms)
        told = batch_refusals(incoming, self._runs(at).pins(), held["floor"], held["head"], now_ms)
        good = told.filter("refusal IS NULL")
        if not good.isEmpty():
            self.log.commit(at, self._state(at) | {"now_ms": now_ms, "pins": self._runs(at).added(good, now_ms)})
        return told

    def refresh_pin(self, receipt: dict, completed: int, now_ms: int, expires_at_ms: int) -> dict:
        at = self.log.snapshot()
        return self._pinned(at, retention.refresh(self._held(at, self._runs(at).find(receipt["holder"])), receipt, completed, now_ms, expires_at_ms), receipt["holder"])

    def pin(self, holder: str) -> dict | None:
        return self._runs(self.log.snapshot()).find(holder)

    def pins(self) -> DataFrame:
        """``holder``, ``completed``, ``expires_at_ms``, ``revision`` of every pin, live or not."""
        return self._runs(self.log.snapshot()).pins()

    def _cutoff(self, at: Snapshot, preferred: int, forced: int | None, now_ms: int) -> int:
        """The cutoff that the live pins allow; the lowest and the highest of them decide."""
        held = retention.advance(self._held(at), now_ms)
        span = self._runs(at).live_span(now_ms)
        ends = {str(k): {"completed": c, "expires_at_ms": now_ms + 1} for k, c in enumerate(span or ())}
        return retention.held_cutoff(held | {"pins": ends}, preferred, forced, now_ms)


class RecordTable(_Pinned):
    """A source of ordered records: append, bounded reads, tails, logical pruning."""

    def __init__(self, spark: SparkSession, path: str, scope: Scope):
        self.spark, self.scope = spark, scope
        self.log = CommitLog(spark, path, "record-source", RECORDS, zone="position")

    def _state(self, at: Snapshot) -> dict:
        return {"head": 0, "floor": 0, "reader": 0, "writer": 0} | at.state

    def _match(self, scope: Scope) -> None:
        s = self.scope
        if (scope.origin, scope.stream, scope.incarnation, scope.schema_id) != (s.origin, s.stream, s.incarnation, s.schema_id):
            raise Refusal("IdentityChanged")

    def head(self, scope: Scope, at: Snapshot | None = None) -> SourceHead:
        self._match(scope)
        state = self._state(at or self.log.snapshot())
        return SourceHead(scope, state["head"], state["reader"], state["writer"])

    def append(self, incoming: DataFrame, expected: SourceHead | None = None, reader: int | None = None, writer: int | None = None) -> int:
        """Append records (``seq``, ``record_id``, ``payload``) in one commit; returns the new head.

        Known ids are looked up in the index of ids, of which a batch reads the buckets that it meets. With ``expected`` the publication must be exactly that; masks may only gain bits.
        """
        at = self.log.snapshot()
        state = self._state(at)
        if expected is not None and (expected.position, expected.reader_required, expected.writer_required) != (state["head"], state["reader"], state["writer"]):
            raise Refusal("Stale")
        reader, writer = state["reader"] if reader is None else reader, state["writer"] if writer is None else writer
        if state["reader"] & ~reader or state["writer"] & ~writer:
            raise Refusal("RequirementsCleared")
        index = IdIndex(self.log, state.get("ids", []))
        plan = records.append_plan(incoming, index.lookup(incoming), state["head"]).cache()
        try:
            bad = plan.filter("refusal IS NOT NULL").select("refusal").first()
            if bad:
                raise Refusal(bad["refusal"])
            new = plan.count()
            if not new and (reader, writer) == (state["reader"], state["writer"]):
                return state["head"]
            head = state["head"] + new
            runs = index.added(plan.filter("refusal IS NULL"), new)
            self.log.commit(at, state | {"head": head, "reader": reader, "writer": writer, "ids": runs}, plan.drop("refusal") if new else None)
            return head
        finally:
            plan.unpersist()

    def page(self, request: PageRequest, at: Snapshot | None = None) -> DataFrame:
        """A bounded page of one snapshot, refused below the floor or above the head."""
        self._match(request.scope)
        at = at or self.log.snapshot()
        state = self._state(at)
        if request.after < state["floor"]:
            raise Refusal("Pruned")
        if request.target <= request.after or request.target > state["head"]:
            raise Refusal("InvalidRequest")
        limits = request.limits.capped()
        near, _, _ = self.log.onward(at, request.after, limits.records)
        sizes = near.filter(F.col("position") <= request.target).select("position", F.octet_length("payload").alias("size"))
        first = sizes.orderBy("position").limit(limits.records).collect()  # a page of sizes
        if not first or first[0]["position"] != request.after + 1:
            raise Refusal("Pruned")
        if first[0]["size"] > min(limits.record_bytes, limits.total_bytes):
            raise Refusal("OversizedRecord")
        # Sizes decide; then the payloads of the page alone are read.
        last, total = request.after, 0
        for r in first:
            total += r["size"]
            if r["size"] > limits.record_bytes or total > limits.total_bytes:
                break
            if r["position"] != last + 1:
                raise Refusal("Pruned")
            last += 1
        return self.log.between(at, request.after, last).select("position", "record_id", "payload")

    def open_page(self, scope: Scope, after: int, limits: Limits) -> tuple[int, DataFrame | None]:
        """Head and first page of one snapshot; no page if the head is not beyond ``after``."""
        at = self.log.snapshot()
        head = self.head(scope, at).position
        return head, self.page(PageRequest(scope, after, head, limits), at) if head > after else None

    def tail(self, scope: Scope, limits: Limits) -> dict:
        self._match(scope)
        at = self.log.snapshot()
        state = self._state(at)
        if not state["head"]:
            return {"first": 1, "watermark": 0, "oldest": 1, "rows": self.log.read(at)}
        near = self.log.between(at, max(state["floor"], state["head"] - limits.capped().records), state["head"])
        rows = near.withColumn("stream", F.lit(scope.stream))
        top = history.tails(rows, "stream", "position", F.octet_length("payload"), limits).first()
        if top is None or top["refusal"]:
            raise Refusal(top["refusal"] if top else "ResetRequired")
        return {"first": top["first"], "watermark": state["head"], "oldest": state["floor"] + 1, "rows": rows.filter(F.col("position") >= top["first"]).drop("stream")}

    def older(self, scope: Scope, before: int, limits: Limits) -> dict:
        self._match(scope)
        at = self.log.snapshot()
        state = self._state(at)
        floor, last = state["floor"], min(before - 1, state["head"])
        near = self.log.between(at, max(floor, last - limits.capped().records), last)
        table = records.Positioned(near.withColumnRenamed("position", "raw"), "raw")
        rows = history.older_page(table, before, floor, limits, F.octet_length("payload")).select("position", "record_id", "payload")
        first = rows.agg(F.min("position")).first()[0]
        if first is None:
            raise Refusal("ResetRequired")
        return {"first": first, "before": before, "oldest": floor + 1, "rows": rows}

    def prune_through(self, floor: int) -> int:
        """Raise the logical floor; rows stay for deduplication."""
        at = self.log.snapshot()
        state = self._state(at)
        if floor > state["head"]:
            raise Refusal("FloorAboveHead")
        if floor > state["floor"]:
            self.log.commit(at, state | {"floor": floor})
        return max(floor, state["floor"])

    def prune_with_retention(self, preferred: int, forced: int | None, now_ms: int) -> int:
        """Raise the logical floor to the cutoff that the live pins allow, chosen and saved in one commit."""
        at = self.log.snapshot()
        floor = self._cutoff(at, preferred, forced, now_ms)
        self.log.commit(at, self._state(at) | {"now_ms": now_ms, "floor": floor})
        return floor


class ReplicaTable:
    """A receiver's copy of one stream, with its checkpoint and history progress."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.log = CommitLog(spark, path, "record-replica", RECORDS, zone="position")

    def load(self, scope: Scope) -> int | None:
        state = self.log.snapshot().state
        if "scope" not in state:
            return None
        if state["scope"] != asdict(scope):
            raise Refusal("ResetRequired")
        return state["position"]

    @staticmethod
    def _check_epoch(at: Snapshot, epoch: tuple[str, int] | None) -> dict:
        """The epochs and the admission saved in a snapshot, which a commit on it keeps.

        Evidence must be of exactly the epoch observed; where an admission is bound, nothing is applied without evidence.
        """
        if epoch is None and at.state.get("admission"):
            raise Refusal("Unadmitted")
        if epoch is not None and at.state.get("epochs", {}).get(epoch[0]) != epoch[1]:
            raise Refusal("StaleEpoch")
        return ReplicaTable._bound(at)

    @staticmethod
    def _bound(at: Snapshot) -> dict:
        return {k: at.state[k] for k in ("epochs", "admission") if at.state.get(k)}

    def bind_admission(self, name: str | None) -> None:
        """Bind the replica to an admission for good; one that is bound opens with no other, nor without."""
        at = self.log.snapshot()
        bound = at.state.get("admission")
        if bound and bound != name:
            raise Refusal("WrongBinding" if name else "Unadmitted")
        if name and not bound:
            self.log.commit(at, at.state | {"admission": name})

    def observe_epoch(self, authority: str, epoch: int) -> int:
        """Raise the durable floor of an authority's epochs."""
        at = self.log.snapshot()
        seen = at.state.get("epochs", {})
        if epoch < seen.get(authority, 0):
            raise Refusal("StaleEpoch")
        if epoch > seen.get(authority, 0):
            self.log.commit(at, at.state | {"epochs": seen | {authority: epoch}})
        return epoch

    def observed_epoch(self, authority: str) -> int:
        return self.log.snapshot().state.get("epochs", {}).get(authority, 0)

    def apply(self, scope: Scope, expected: int, plan: DataFrame, epoch: tuple[str, int] | None = None) -> int:
        """Apply records after ``expected``; an exact replay is a quiet success."""
        at = self.log.snapshot()
        self._check_epoch(at, epoch)
        state = {"scope": asdict(scope), "position": 0, "history": None} | at.state
        if state["scope"] != asdict(scope):
            raise Refusal("ResetRequired")
        if state["history"] and state["history"]["deleted"]:
            raise Refusal("Deleted")
        plan = plan.select("position", "record_id", "payload")
        span = plan.agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.count("*").alias("n"), F.count_distinct("record_id").alias("ids")).first()
        if not span["n"] or span["hi"] - span["lo"] + 1 != span["n"] or span["ids"] != span["n"]:
            raise Refusal("InvalidPlan")
        if state["position"] >= span["hi"] and records.is_exact_replay(plan, self.log.between(at, span["lo"] - 1, span["hi"])).first()["exact"]:
            return state["position"]
        index = IdIndex(self.log, state.get("ids", []))
        known = index.lookup(plan).select("record_id", F.col("position").alias("__p"), F.col("digest").alias("__b"))
        if not plan.join(known, "record_id").filter((F.col("position") != F.col("__p")) | (digest(F.col("payload")) != F.col("__b"))).isEmpty():
            raise Refusal("ConflictingRecord")
        if state["position"] != expected or span["lo"] != expected + 1:
            raise Refusal("Stale")
        moved = state | {"position": span["hi"], "ids": index.added(plan, span["n"])}
        if state["history"]:
            moved["history"] = state["history"] | {"live_head": span["hi"]}
        self.log.commit(at, moved, plan)
        return span["hi"]

    def read_after(self, scope: Scope, after: int, limits: Limits) -> DataFrame:
        """A local page, never past the committed checkpoint."""
        at = self.log.snapshot()
        position = at.state.get("position", 0)
        if after >= position:
            return self.log.read(at).limit(0)
        near, _, _ = self.log.onward(at, after, limits.capped().records)
        table = records.Positioned(near.withColumnRenamed("position", "raw"), "raw")
        return records.page(table, after, position, limits, F.octet_length("payload")).select("position", "record_id", "payload")

    def count(self) -> int:
        return self.log.read().count()

    def progress(self) -> dict | None:
        return (self.log.snapshot().state or {}).get("history")

    def install_tail(self, scope: Scope, generation: int, tail: dict, epoch: tuple[str, int] | None = None) -> dict:
        at = self.log.snapshot()
        epochs = self._check_epoch(at, epoch)
        before = at.state.get("history")
        progress = history.progress_after_tail(before, generation, tail["first"], tail["watermark"], tail["oldest"], "scope" in at.state and before is None)
        rows = tail["rows"]
        ids = IdIndex(self.log, []).added(rows, rows.count())
        self.log.commit(at, {"scope": asdict(scope), "position": tail["watermark"], "history": progress, "ids": ids} | epochs, rows, replace=True)
        return progress

    def install_older(self, scope: Scope, generation: int, page: dict, epoch: tuple[str, int] | None = None) -> dict:
        at = self.log.snapshot()
        self._check_epoch(at, epoch)
        if not at.state.get("history"):
            raise Refusal("Stale")
        progress = history.progress_after_older(at.state["history"], generation, page["first"], page["before"] - 1, page["oldest"])
        saved = self.log.between(at, page["first"] - 1, page["before"] - 1)
        if not history.overlap_conflicts(page["rows"], saved, ["position"]).isEmpty():
            raise Refusal("ConflictingRecord")
        fresh = history.missing_prefix(page["rows"], saved, ["position"])
        ids = IdIndex(self.log, at.state.get("ids", [])).added(fresh, fresh.count())
        self.log.commit(at, at.state | {"history": progress, "ids": ids}, fresh)
        return progress

    def fence_deletion(self, scope: Scope) -> dict:
        at = self.log.snapshot()
        progress = history.progress_after_deletion(at.state.get("history"))
        self.log.commit(at, {"scope": asdict(scope), "position": 0, "history": progress} | self._bound(at), self.log.read(at).limit(0), replace=True)
        return progress


class CatalogueTable(_Pinned):
    """A source of current values: folded batches of mutations, collection, compaction.

    A commit appends the entries that it changes; reads fold the segments, the latest state of each entry first. An entry's creation
    never changes, so all its states lie in one range of creations, and segments are kept in that order: a page of the manifest folds
    the files of its own range. Merges of segments keep the latest state. Retired entries stay as rows that only prove their
    identity and revision, so they fence their ids for ever.
    """

    FLOOR = "horizon"
    COMPACT_AFTER = 64

    def __init__(self, spark: SparkSession, path: str, scope: Scope):
        self.spark, self.scope = spark, scope
        schema = StructType([*ENTRIES.fields, StructField("retired", BooleanType(), False)])
        self.log = CommitLog(spark, path, "catalogue-source", schema, zone="creation", top="revision", fold=self._newest)

    def _state(self, at: Snapshot) -> dict:
        return {"head": 0, "horizon": 0} | at.state

    def snapshot(self) -> Snapshot:
        """A version that several reads can share."""
        return self.log.snapshot()

    def head(self, at: Snapshot | None = None) -> int:
        return self._state(at or self.log.snapshot())["head"]

    def horizon(self, at: Snapshot | None = None) -> int:
        return self._state(at or self.log.snapshot())["horizon"]

    def _now(self, at: Snapshot, ids: DataFrame | None = None) -> DataFrame:
        """The latest state of every entry, or of those in ``ids``: deletion, hiding and retirement follow in this order at one revision."""
        rows = self.log.read(at)
        if ids is not None:
            rows = rows.join(ids.select("entry_id").distinct(), "entry_id", "left_semi")
        return self._newest(rows)

    def _newest(self, rows: DataFrame) -> DataFrame:
        names = [f.name for f in self.log.schema if f.name != "entry_id"]
        newest = F.max_by(F.struct(*names), F.struct("revision", "deleted", ~F.col("visible"), "retired"))
        return rows.groupBy("entry_id").agg(newest.alias("e")).select("entry_id", "e.*")

    def manifest_page(self, boundary: int, completed: int, cursor: tuple[int, str] | None, limit: int, at: Snapshot | None = None) -> tuple[list, int]:
        """Descriptors of the next ``limit`` entries after ``cursor``, and one more if others follow; and how many files were opened.

        Files whose entries all were complete before are passed over. Where a range has few entries that count, the next one is wider.
        """
        at = at or self.log.snapshot()
        after, want, found, opened = (cursor[0] - 1 if cursor else 0), limit + 1, [], 0
        while True:
            rows, bound, files = self.log.onward(at, after, want, above=completed)
            shown = self._newest(rows).filter("NOT retired")
            found += catalogue.manifest(shown, boundary, completed, cursor, limit).collect()  # limit + 1 descriptors at most
            opened += files
            if len(found) > limit or bound is None or bound >= boundary:
                return found[: limit + 1], opened
            after, want = bound, want * 4

    def manifest_span(self, boundary: int, completed: int, cursor: tuple[int, str] | None, rows: int, at: Snapshot | None = None) -> DataFrame:
        """Descriptors of all entries of a range after ``cursor``, in no order: at least ``rows``, unless they end before."""
        at = at or self.log.snapshot()
        want = rows
        while True:
            states, bound, _ = self.log.onward(at, cursor[0] - 1 if cursor else 0, want, above=completed)
            found = catalogue.shown(self._newest(states).filter("NOT retired"), boundary, completed, cursor)
            if bound is None or bound >= boundary or found.count() >= rows:
                return found
            want *= 4

    def states(self, low: int, high: int, at: Snapshot | None = None) -> tuple[DataFrame, DataFrame]:
        """Entries and proofs whose creations are in low to high."""
        now = self._newest(self.log.between(at or self.log.snapshot(), low - 1, high))
        return now.filter("NOT retired").drop("retired"), now.filter("retired").select("entry_id", "creation", "revision")

    def entries(self, at: Snapshot | None = None) -> DataFrame:
        return self._now(at or self.log.snapshot()).filter("NOT retired").drop("retired")

    def proofs(self, at: Snapshot | None = None) -> DataFrame:
        return self._now(at or self.log.snapshot()).filter("retired").select("entry_id", "creation", "revision")

    def _commit(self, at: Snapshot, state: dict, rows: DataFrame | None, few: bool = False) -> None:
        done = self.log.commit(at, state, rows, few=few)
        if len(done.segments) > self.COMPACT_AFTER:
            try:
                self.log.compact(done, self._now(done))
            except Refusal:  # another writer was faster; the next commit tries again
                pass

    def apply(self, mutations: DataFrame, expected: int | None = None, mark: dict | None = None) -> DataFrame:
        """Fold a batch (``seq``, ``entry_id``, ``is_del``, ``payload``) onto the current values; returns its outcomes.

        Mutations come in order: a batch that begins at or below the last ``seq`` applied is Stale, one with a repeated or missing ``seq`` is
        an InvalidPlan, and neither changes anything.

        Current values enter the fold as mutations before the batch, so one operator decides both. Only entries that the batch
        names are read and written. With ``expected`` the head must be exactly that; ``mark`` is saved in the same commit.
        """
        at = self.log.snapshot()
        state = self._state(at) | (mark or {})
        if expected is not None and expected != state["head"]:
            raise Refusal("Stale")
        span = mutations.agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n"), F.count_distinct("seq").alias("seqs")).first()
        lowest = span["low"]
        if span["n"] != span["seqs"]:
            raise Refusal("InvalidPlan", "a seq is missing or repeated")
        if lowest is not None and lowest <= state.get("seq", lowest - 1):
            raise Refusal("Stale", f"seq {lowest} is not after {state['seq']}")
        if lowest is None:
            if mark:
                self._commit(at, state, None)
            return mutations.withColumn("outcome", F.lit(None).cast("string"))
        now = self._now(at, mutations)
        kind = mutations.schema["payload"].dataType
        born = now.select((F.lit(lowest - 2).cast("bigint")).alias("seq"), "entry_id", F.lit(False).alias("is_del"), F.col("payload").cast(kind).alias("payload"))
        died = now.filter("deleted").select(F.lit(lowest - 1).cast("bigint").alias("seq"), "entry_id", F.lit(True).alias("is_del"), F.lit(None).cast(kind).alias("payload"))
        cols = ["seq", "entry_id", "is_del", "payload"]
        told = catalogue.outcomes(born.unionByName(died).unionByName(mutations.select(*cols))).filter(F.col("seq") >= lowest).persist()
        try:
            self._publish(at, state, span["high"], told, now)
        finally:
            told.unpersist()
        return told

    def _publish(self, at: Snapshot, state: dict, high: int, told: DataFrame, now: DataFrame) -> None:
        """Commit what the accepted mutations of a batch make of its entries."""
        accepted = told.filter("outcome = 'accepted'")
        kept = with_rank(accepted, "seq", "rank").withColumn("revision", F.col("rank") + state["head"])
        fresh = catalogue.current(kept).withColumns({"visible": F.lit(True), "retired": F.lit(False)})
        old = now.select("entry_id", F.col("creation").alias("__creation"))
        fresh = fresh.join(old, "entry_id", "left").withColumn("creation", F.coalesce("__creation", "creation")).drop("__creation")
        fresh = fresh.withColumn("payload", F.when(~F.col("deleted"), F.col("payload")))
        head = state["head"] + accepted.count()
        self._commit(at, state | {"head": head, "seq": high}, fresh if head > state["head"] else None)

    def collect(self, horizon: int, expected: tuple[int, int] | None = None) -> int:
        """Hide markers below the horizon; returns how many. With ``expected``, head and horizon must be exactly these."""
        at = self.log.snapshot()
        state = self._state(at)
        if expected is not None and expected != (state["head"], state["horizon"]):
            raise Refusal("Stale")
        return self._collect(at, state, horizon)

    def _markers(self, name: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.log.path}/hidden/{name}", "hidden-markers", PROOFS, zone="revision", tiers=False)

    def _collect(self, at: Snapshot, state: dict, horizon: int) -> int:
        shown = self._now(at).filter("deleted AND visible")
        hidden = catalogue.collect(shown, horizon, self._state(at)["horizon"], state["head"]).filter("NOT visible")
        changed = hidden.count()
        listed = state.get("hidden", {"lists": [], "after": 0})
        if changed:
            # Markers hidden now are younger than those hidden before: the lists follow each other by revision.
            name = uuid.uuid4().hex
            markers = self._markers(name)
            markers.commit(markers.snapshot(), {}, hidden)
            listed = listed | {"lists": [*listed["lists"], name]}
        self._commit(at, state | {"horizon": horizon, "hidden": listed}, hidden if changed else None)
        return changed

    def collect_with_retention(self, preferred: int, forced: int | None, now_ms: int) -> int:
        """Raise the horizon to the cutoff that the live pins allow, chosen and saved in one commit; returns it."""
        at = self.log.snapshot()
        horizon = self._cutoff(at, preferred, forced, now_ms)
        self._collect(at, self._state(at) | {"now_ms": now_ms}, horizon)
        return horizon

    def compact_retired(self, limit: int = MAX_COMPACTION_BATCH) -> int:
        """Turn the oldest hidden markers, a batch at most, into proofs, in one commit; returns how many.

        The lists kept at each collection are consumed from the front, so a batch reads a batch and not the catalogue.
        """
        if not 0 < limit <= MAX_COMPACTION_BATCH:
            raise Refusal("Failed")
        at = self.log.snapshot()
        state = self._state(at)
        listed = state.get("hidden", {"lists": [], "after": 0})
        lists, after, batch = list(listed["lists"]), listed["after"], []
        while lists and len(batch) < limit:
            markers = self._markers(lists[0])
            rows, bound, _ = markers.onward(markers.snapshot(), after, limit - len(batch))
            found = rows.orderBy("revision").limit(limit - len(batch)).collect()  # a batch of descriptors at most
            batch += found
            if found:
                after = found[-1]["revision"]
            if len(batch) < limit and bound is None:
                lists.pop(0)
        if batch:
            moved = [(r["entry_id"], r["creation"], r["revision"], True, None, False, True) for r in batch]
            rows = self.spark.createDataFrame(moved, self.log.schema)
            self._commit(at, state | {"hidden": {"lists": lists, "after": after}}, rows, few=True)
        return len(batch)

    def compact_all_retired(self) -> int:
        """Turn all hidden markers into proofs, in one commit; returns how many."""
        at = self.log.snapshot()
        state = self._state(at)
        listed = state.get("hidden", {"lists": [], "after": 0})
        logs = [self._markers(name) for name in listed["lists"]]
        if not logs:
            return 0
        rows = functools.reduce(DataFrame.unionByName, [m.read() for m in logs]).filter(F.col("revision") > listed["after"])
        moved = rows.select("*", F.lit(True).alias("deleted"), F.lit(None).cast("binary").alias("payload"), F.lit(False).alias("visible"), F.lit(True).alias("retired"))
        count = moved.count()
        self._commit(at, state | {"hidden": {"lists": [], "after": state["horizon"]}}, moved if count else None)
        return count


class ArtifactTable:
    """A source of artifacts: versions with length and digest, tombstones that stay, exact chunks.

    Manifests (rows without an offset) and chunks are appended; the manifest of the highest revision is current.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.log = CommitLog(spark, path, "artifact-source", ARTIFACTS, fold=self._kept)

    @staticmethod
    def _kept(rows: DataFrame) -> DataFrame:
        """What a merge keeps: of each artifact the newest manifest there and what is not older; a tombstone stays."""
        newest = rows.filter("offset IS NULL").groupBy("artifact_id").agg(F.max("revision").alias("__top"))
        return rows.join(newest, "artifact_id", "left").filter("__top IS NULL OR revision >= __top").drop("__top")

    def manifests(self, at: Snapshot | None = None) -> DataFrame:
        """``artifact_id``, ``revision``, ``deleted``, ``length``, ``digest`` of the current version of every artifact."""
        rows = self.log.read(at or self.log.snapshot()).filter("offset IS NULL")
        newest = F.max_by(F.struct("revision", "deleted", "length", "digest"), "revision")
        return rows.groupBy("artifact_id").agg(newest.alias("m")).select("artifact_id", "m.*")

    def upsert(self, incoming: DataFrame) -> DataFrame:
        """Add versions (``artifact_id``, ``payload``); returns ``artifact_id`` and ``outcome``: accepted, quiet for equal bytes, fenced."""
        at = self.log.snapshot()
        head = at.state.get("head", 0)
        told = artifacts.upsert_outcomes(incoming, self.manifests(at), head)
        fresh = told.filter("outcome = 'accepted'")
        n = fresh.count()
        if n:
            rows = fresh.select("artifact_id", "revision", F.lit(False).alias("deleted"), "length", "digest", "payload")
            manifest = rows.drop("payload").withColumns({"offset": F.lit(None).cast("bigint"), "bytes": F.lit(None).cast("binary")})
            cut = artifacts.chunks(rows).join(rows.drop("payload"), "artifact_id")
            self.log.commit(at, at.state | {"head": head + n}, manifest.unionByName(cut.select(*manifest.columns)))
        return told.select("artifact_id", "outcome")

    def delete(self, artifact_id: str) -> int:
        """Set a permanent tombstone; a second one is quiet. Returns its revision."""
        at = self.log.snapshot()
        old = self.manifests(at).filter(F.col("artifact_id") == artifact_id).first()
        if old is None:
            raise Refusal("Missing")
        if old["deleted"]:
            return old["revision"]
        head = at.state.get("head", 0) + 1
        self.log.commit(at, at.state | {"head": head}, self.spark.createDataFrame([(artifact_id, head, True, 0, "", None, None)], ARTIFACTS))
        return head

    def manifest(self, artifact_id: str) -> dict:
        """The current state of an artifact; ``Missing`` never means deletion."""
        row = self.manifests().filter(F.col("artifact_id") == artifact_id).first()
        if row is None:
            raise Refusal("Missing")
        return row.asDict()

    def chunk(self, artifact_id: str, revision: int, offset: int, size: int) -> bytes:
        """Bytes of exactly the version asked for, if it is still current."""
        at = self.log.snapshot()
        now = self.manifests(at).filter(F.col("artifact_id") == artifact_id).first()
        if now is None or now["deleted"] or now["revision"] != revision:
            raise Refusal("Stale")
        if not 0 < size <= MAX_CHUNK_BYTES or not 0 <= offset < now["length"]:
            raise Refusal("InvalidRequest")
        first, last = offset - offset % MAX_CHUNK_BYTES, offset + size
        mine = (F.col("artifact_id") == artifact_id) & (F.col("revision") == revision) & F.col("offset").between(first, last - 1)
        held = b"".join(bytes(r["bytes"]) for r in self.log.read(at).filter(mine).orderBy("offset").collect())  # two stored chunks at most
        return held[offset - first : last - first]


class ArtifactCache:
    """A receiver's chunks of one artifact scope; bytes count as verified only after their full hash.

    Everything is an appended row (manifest, chunk, verified, dropped), numbered by the version that brought it; reads fold them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.log = CommitLog(spark, path, "artifact-cache", STAGED, fold=self._kept)

    @staticmethod
    def _kept(rows: DataFrame) -> DataFrame:
        """What a merge keeps: of each artifact the newest manifest there and what is not older, without chunks that were dropped since."""
        top = F.max(F.when(F.col("kind") == "manifest", F.col("revision"))).alias("__top")
        dropped = F.max(F.when(F.col("kind") == "dropped", F.struct("revision", "version"))).alias("__dropped")
        marks = rows.groupBy("artifact_id").agg(top, dropped)
        gone = (F.col("kind") == "chunk") & (F.col("revision") == F.col("__dropped.revision")) & (F.col("version") <= F.col("__dropped.version"))
        kept = rows.join(marks, "artifact_id").filter("__top IS NULL OR revision >= __top").filter(~F.coalesce(gone, F.lit(False)))
        return kept.drop("__top", "__dropped")

    def _row(self, at: Snapshot, kind: str, artifact_id: str, revision: int, **more) -> DataFrame:
        values = {"artifact_id": artifact_id, "version": at.version + 1, "kind": kind, "revision": revision} | more
        return self.spark.createDataFrame([tuple(values.get(f.name) for f in STAGED)], STAGED)

    def index(self, at: Snapshot | None = None) -> DataFrame:
        """``artifact_id``, ``revision``, ``deleted``, ``length``, ``digest``, ``next`` and ``verified`` of every artifact."""
        rows = self.log.read(at or self.log.snapshot())
        newest = F.max_by(F.struct("revision", "deleted", "length", "digest"), F.when(F.col("kind") == "manifest", F.struct("revision", "version")))
        now = rows.groupBy("artifact_id").agg(newest.alias("m")).select("artifact_id", "m.*")
        mine = rows.join(now.select("artifact_id", "revision"), ["artifact_id", "revision"], "left_semi")
        dropped = F.max(F.when(F.col("kind") == "dropped", F.col("version")))
        marks = mine.groupBy("artifact_id").agg(F.coalesce(dropped, F.lit(0)).alias("dropped"), F.coalesce(F.max(F.when(F.col("kind") == "verified", F.col("version"))), F.lit(0)).alias("good"))
        staged = mine.filter("kind = 'chunk'").select("artifact_id", "version", F.octet_length("bytes").alias("n")).join(marks, "artifact_id").filter("version > dropped")
        sums = staged.groupBy("artifact_id").agg(F.sum("n").cast("bigint").alias("next"))
        out = now.join(marks, "artifact_id").join(sums, "artifact_id", "left")
        return out.select("artifact_id", "revision", "deleted", "length", "digest", F.coalesce("next", F.lit(0)).alias("next"), (F.col("good") > F.col("dropped")).alias("verified"), "dropped")

    def _find(self, artifact_id: str, at: Snapshot) -> dict | None:
        row = self.index(at).filter(F.col("artifact_id") == artifact_id).first()
        return row.asDict() if row else None

    def _chunks(self, at: Snapshot, state: dict) -> DataFrame:
        mine = (F.col("artifact_id") == state["artifact_id"]) & (F.col("revision") == state["revision"]) & (F.col("kind") == "chunk") & (F.col("version") > state["dropped"])
        return self.log.read(at).filter(mine).select("artifact_id", "offset", "bytes")

    def accept(self, artifact_id: str, revision: int, length: int, digest: str, deleted: bool = False) -> dict:
        """Take a manifest: a newer one leaves what was staged behind; a deletion stays for ever."""
        at = self.log.snapshot()
        if at.state.get("revoked"):
            raise Refusal("Revoked")
        old = self._find(artifact_id, at)
        refusal = artifacts.manifest_verdict(old, revision, length, digest, deleted)
        if refusal:
            raise Refusal(refusal)
        if old and revision == old["revision"]:
            return old
        self.log.commit(at, at.state, self._row(at, "manifest", artifact_id, revision, deleted=deleted, length=length, digest=digest))
        return {"artifact_id": artifact_id, "revision": revision, "deleted": deleted, "length": length, "digest": digest, "next": 0, "verified": False, "dropped": 0}

    def append(self, artifact_id: str, offset: int, data: bytes) -> dict:
        """Stage the next chunk; the same chunk again is quiet."""
        return self.append_all(artifact_id, [(offset, data)])

    def append_all(self, artifact_id: str, parts: list[tuple[int, bytes]]) -> dict:
        """Stage consecutive chunks in one commit; those that are staged already must be the same."""
        at = self.log.snapshot()
        state = self._find(artifact_id, at)
        if not state or state["deleted"] or at.state.get("revoked"):
            raise Refusal("Stale")
        fresh, upto = [], state["next"]
        for offset, data in parts:
            if offset < state["next"]:
                row = self._chunks(at, state).filter(F.col("offset") == offset).first()
                if not row or bytes(row["bytes"]) != data:
                    raise Refusal("Conflict")
                continue
            if offset != upto or upto + len(data) > state["length"] or not 0 < len(data) <= MAX_CHUNK_BYTES:
                raise Refusal("WrongOffset")
            fresh.append((artifact_id, at.version + 1, "chunk", state["revision"], None, None, None, offset, bytearray(data)))
            upto += len(data)
        if fresh:
            self.log.commit(at, at.state, self.spark.createDataFrame(fresh, STAGED))
        return state | {"next": upto}

    def publish(self, artifact_id: str) -> dict:
        """Verify order, length and hash; a mismatch discards what was staged."""
        at = self.log.snapshot()
        state = self._find(artifact_id, at)
        if not state or state["deleted"] or at.state.get("revoked"):
            raise Refusal("Stale")
        good = self._matches(at, state)
        self.log.commit(at, at.state, self._row(at, "verified" if good else "dropped", artifact_id, state["revision"]))
        if not good:
            raise Refusal("HashMismatch")
        return state | {"verified": True}

    def _matches(self, at: Snapshot, state: dict) -> bool:
        manifest = self.spark.createDataFrame([(state["artifact_id"], state["length"], state["digest"])], "artifact_id string, length bigint, digest string")
        return artifacts.verify(manifest, artifacts.assemble(self._chunks(at, state))).first()["verified"]

    def lookup(self, artifact_id: str) -> dict | None:
        """What the index knows of an artifact; nothing of a revoked scope."""
        at = self.log.snapshot()
        return None if at.state.get("revoked") else self._find(artifact_id, at)

    def read_verified(self, artifact_id: str) -> DataFrame | None:
        """The chunks of a verified artifact in order, hashed again, or None."""
        at = self.log.snapshot()
        state = self._find(artifact_id, at)
        if not state or not state["verified"] or state["deleted"] or at.state.get("revoked"):
            return None
        if not self._matches(at, state):
            raise Refusal("HashMismatch")
        return self._chunks(at, state).orderBy("offset")

    def revoke(self) -> None:
        """Drop all bytes of this scope's epoch; it never resumes."""
        at = self.log.snapshot()
        self.log.commit(at, at.state | {"revoked": True}, self.log.read(at).limit(0), replace=True)
