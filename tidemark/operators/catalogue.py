"""Current-value catalogues: the fold of a mutation log, manifests, merges, collection and recovery.

Logs have ``seq`` (dense integers), ``entry_id``, ``is_del`` and ``payload``. Deletion is
permanent: an entry's first effective deletion fences it, and absence never
means deletion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import BUCKET, last_before, with_rank
from tidemark.schema import MAX_CATALOGUE_ENTRIES, MAX_COMPACTION_BATCH, Refusal


def outcomes(log: DataFrame, width: int = BUCKET) -> DataFrame:
    """The log with ``outcome`` of each mutation: accepted, quiet, missing or fenced.

    Fences come from two aggregations by entry (first upsert, then first deletion after it); only
    the comparison with the current value needs an ordered window, which is cut into buckets.
    """
    upserts = log.filter("NOT is_del").groupBy("entry_id").agg(F.min("seq").alias("__born"))
    deaths = log.filter("is_del").join(upserts, "entry_id").filter("seq > __born").groupBy("entry_id").agg(F.min("seq").alias("__died"))
    current = last_before(log, "entry_id", "seq", F.when(~F.col("is_del"), F.struct("payload")), "__current", width)
    rows = current.join(upserts, "entry_id", "left").join(deaths, "entry_id", "left")
    outcome = (
        F.when(F.col("seq") > F.col("__died"), "fenced")
        .when(F.col("is_del") & (F.col("__born").isNull() | (F.col("seq") < F.col("__born"))), "missing")
        .when(~F.col("is_del") & F.col("__current").isNotNull() & F.col("__current.payload").eqNullSafe(F.col("payload")), "quiet")
        .otherwise("accepted")
    )
    return rows.withColumn("outcome", outcome).drop("__current", "__born", "__died")


def accepted(log: DataFrame, width: int = BUCKET) -> DataFrame:
    """Accepted mutations with gap-free global revisions, in the order of ``seq``."""
    return with_rank(outcomes(log, width).filter("outcome = 'accepted'"), "seq", "revision", width)


def current(mutations: DataFrame) -> DataFrame:
    """One row for each entry: creation and current revision, deletion marker, current payload (none if deleted)."""
    return mutations.groupBy("entry_id").agg(
        F.min("revision").alias("creation"),
        F.max("revision").alias("revision"),
        F.bool_or("is_del").alias("deleted"),
        F.max_by(F.when(~F.col("is_del"), F.col("payload")), "revision").alias("payload"),
    )


def as_of(mutations: DataFrame, boundary: int) -> DataFrame:
    """The catalogue after the mutation of revision ``boundary``."""
    return current(mutations.filter(F.col("revision") <= boundary))


def shown(entries: DataFrame, boundary: int, completed: int, cursor: tuple[int, str] | None) -> DataFrame:
    """Descriptors, without payloads, of all entries that a pass has still to see."""
    rows = entries.filter((F.col("creation") <= boundary) & (F.col("revision") > completed))
    if "visible" in entries.columns:
        rows = rows.filter("visible")
    if cursor:
        rows = rows.filter((F.col("creation") > cursor[0]) | ((F.col("creation") == cursor[0]) & (F.col("entry_id") > cursor[1])))
    return rows.select("entry_id", "creation", "revision", "deleted")


def manifest(entries: DataFrame, boundary: int, completed: int, cursor: tuple[int, str] | None, limit: int) -> DataFrame:
    """A keyset page of descriptors in (creation, id) order; one row more than ``limit`` proves that more follow."""
    if not 0 < limit <= MAX_CATALOGUE_ENTRIES:
        raise Refusal("InvalidRequest")
    return shown(entries, boundary, completed, cursor).orderBy("creation", "entry_id").limit(limit + 1)


def manifest_page(probe: DataFrame, limit: int) -> DataFrame:
    return probe.orderBy("creation", "entry_id").limit(limit)


def has_more(probe: DataFrame, limit: int) -> DataFrame:
    return probe.agg((F.count("*") > limit).alias("has_more"), F.least(F.count("*"), F.lit(limit)).alias("entries"))


def classify(page: DataFrame, cached: DataFrame) -> DataFrame:
    """Split a manifest page: entries cached at its revision or later are unchanged, the others are to be resolved."""
    c = cached.select("entry_id", F.col("revision").alias("cached_revision"))
    unchanged = F.col("cached_revision") >= F.col("revision")
    return page.join(c, "entry_id", "left").withColumn("action", F.when(unchanged, "unchanged").otherwise("resolve"))


def resolve(ids: DataFrame, entries: DataFrame, proofs: DataFrame) -> DataFrame:
    """Current values or deletion markers by id; retired entries answer from their proofs."""
    cols = ["entry_id", "creation", "revision", "deleted", "payload"]
    retired = proofs.select("entry_id", "creation", "revision", F.lit(True).alias("deleted"), F.lit(None).cast(entries.schema["payload"].dataType).alias("payload"))
    return ids.select("entry_id").distinct().join(entries.select(*cols).unionByName(retired), "entry_id")


def transition_refusal(before: str, after: str) -> Column:
    """Why a descriptor may not follow another of the same entry."""

    def b(n: str) -> Column:
        return F.col(f"{before}.{n}")

    def a(n: str) -> Column:
        return F.col(f"{after}.{n}")

    turned = (a("revision") == b("revision")) & (a("deleted") != b("deleted"))
    wrong = (b("creation") != a("creation")) | (a("revision") < b("revision")) | turned
    return F.when(wrong, "WrongPayload").when(b("deleted") & ~a("deleted"), "DeletionFence")


def merge(cached: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest-wins merge by entry: one union and one aggregation. Deleted entries keep no payload; none is dropped."""
    cols = ["entry_id", "creation", "revision", "deleted", "payload"]
    both = cached.select(*cols).unionByName(incoming.select(*cols))
    newest = both.groupBy("entry_id").agg(F.max_by(F.struct("creation", "revision", "deleted", "payload"), F.struct("revision", "deleted")).alias("e"))
    return newest.select("entry_id", "e.*")


def reset_survivors(cached: DataFrame) -> DataFrame:
    """What a reset keeps: deletion markers."""
    return cached.filter("deleted")


def collect(entries: DataFrame, horizon: int, previous: int, head: int) -> DataFrame:
    """Hide markers strictly below a horizon that may only rise, up to the head."""
    if not previous <= horizon <= head:
        raise Refusal("InvalidHorizon", f"{previous} <= {horizon} <= {head}")
    return entries.withColumn("visible", F.expr("visible") & ~(F.col("deleted") & (F.col("revision") < horizon)))


def coverage(progress: DataFrame, horizon: int) -> DataFrame:
    """Receivers (``receiver``, ``completed``, ``boundary``, ``full_reset``) whose coverage has expired.

    An incremental pass is covered from its completed revision, a full reset from its boundary; equality is covered.
    """
    base = F.when(F.col("full_reset"), F.col("boundary")).otherwise(F.col("completed"))
    return progress.withColumn("base", base).withColumn("expired", F.col("base") < horizon)


def compaction_batch(entries: DataFrame, horizon: int, limit: int = MAX_COMPACTION_BATCH) -> DataFrame:
    """Hidden markers below the horizon that move to proofs, oldest first, a batch at most."""
    if not 0 < limit <= MAX_COMPACTION_BATCH:
        raise Refusal("Failed")
    hidden = entries.filter((~F.col("visible")) & F.col("deleted") & (F.coalesce(F.octet_length("payload"), F.lit(0)) == 0) & (F.col("revision") < horizon))
    return hidden.select("entry_id", "creation", "revision").orderBy("revision", "entry_id").limit(limit)


def compact(entries: DataFrame, proofs: DataFrame, horizon: int, limit: int = MAX_COMPACTION_BATCH) -> tuple[DataFrame, DataFrame]:
    """Entries and proofs after one batch has moved; the batch is a bounded broadcast."""
    batch = compaction_batch(entries, horizon, limit)
    return entries.join(F.broadcast(batch.select("entry_id")), "entry_id", "left_anti"), proofs.unionByName(batch)


def candidate_floors(live: DataFrame, pending: DataFrame) -> DataFrame:
    """Recovery candidates: live rows and pending candidates, the later revision of each entry."""
    rows = live.filter("NOT deleted").select("entry_id", "creation", "revision").unionByName(pending.select("entry_id", "creation", "revision"))
    return rows.groupBy("entry_id").agg(F.min("creation").alias("creation"), F.max("revision").alias("revision"))


def creation_conflicts(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """How many candidates are saved with another creation."""
    e = entries.select("entry_id", F.col("creation").alias("__c"))
    return candidates.join(e, "entry_id").agg(F.count_if(F.col("creation") != F.col("__c")).alias("conflicts"))


def highest_revision(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The highest revision over both, 0 if none; a boundary below it needs a reset."""
    return entries.select("revision").unionByName(candidates.select("revision")).agg(F.coalesce(F.max("revision"), F.lit(0)).alias("highest"))


def remaining(candidates: DataFrame, classified: DataFrame) -> DataFrame:
    """Candidates that no page or value has settled."""
    return candidates.join(classified.select("entry_id"), "entry_id", "left_anti")


def page_cover(manifest_rows: DataFrame, resolved: DataFrame, unchanged: DataFrame) -> DataFrame:
    """One row: manifest ids in none or in both of the two lists, and listed ids that are not in the manifest."""
    rows = (
        manifest_rows.select("entry_id", F.lit(1).alias("m"), F.lit(0).alias("r"))
        .unionByName(resolved.select("entry_id", F.lit(0).alias("m"), F.lit(1).alias("r")))
        .unionByName(unchanged.select("entry_id", F.lit(0).alias("m"), F.lit(1).alias("r")))
    )
    seen = rows.groupBy("entry_id").agg(F.sum("m").alias("m"), F.sum("r").alias("r"))
    return seen.agg(F.count_if(F.expr("m = 1 AND r <> 1")).alias("uncovered"), F.count_if(F.expr("m = 0")).alias("foreign_ids"), F.count_if(F.expr("m > 1")).alias("repeated"))
