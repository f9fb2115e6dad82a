"""The registered queries of the engine's operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import bindings as B
from tidemark.functions import columns as C
from tidemark.operators import artifacts, catalogue, history, ordering, projections, records, retention, validate
from tidemark.schema import RECORDS, Limits, Refusal
from tidemark.sources.commitlog import CommitLog
from tidemark.streaming.follow import follow
from tidemark.workdir import work_dir

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from tidemark import catalog_checks

    return dict(_QUERIES) | catalog_checks.queries()


def oracle_sql() -> dict[str, str]:
    from tidemark import catalog_checks

    return dict(_SQL) | catalog_checks.oracle_sql()


def _size():
    return F.octet_length("payload").cast("bigint")


_EVENT = "SELECT event_id + 1 AS position, 'e' || event_id AS record_id, event_type || '|' || coalesce(props, '') AS payload FROM events"
_TURN = "SELECT conv_id, turn + 1 AS position, conv_id || '-' || turn AS record_id, role, coalesce(text, '') AS payload FROM conversations"
_CUT = "max(CASE WHEN size > {record} OR running > {total} THEN 1 ELSE 0 END) OVER ({over} ROWS UNBOUNDED PRECEDING)"


# --- records ---------------------------------------------------------------

@_register("record_head", "SELECT max(event_id) + 1 AS head FROM events")
def record_head(spark, sf):
    return B.event_records(spark, sf).head()


@_register("record_page_budget", """
WITH p AS (SELECT doc_id + 1 AS position, doc_id, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE doc_id >= 100 AND doc_id < 400 ORDER BY doc_id LIMIT 64),
r AS (SELECT *, sum(size) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING) AS running FROM p),
c AS (SELECT *, max(CASE WHEN size > 20000 OR running > 65536 THEN 1 ELSE 0 END) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING) AS cut FROM r)
SELECT position, doc_id, size FROM c WHERE cut = 0""")
def record_page_budget(spark, sf):
    rows = records.page(B.document_records(spark, sf), 100, 400, Limits(64, 65536, 20000), F.col("size"))
    return rows.select("position", "doc_id", "size")


@_register("record_page_refusal", """
WITH h AS (SELECT max(event_id) + 1 AS head FROM events)
SELECT 1 AS asked, CASE WHEN 2000000 > head THEN 'InvalidRange' END AS refusal FROM h
UNION ALL SELECT 2, 'Pruned' UNION ALL SELECT 3, 'OversizedRecord' UNION ALL SELECT 4, NULL""")
def record_page_refusal(spark, sf):
    e = B.event_records(spark, sf)
    asked = [(0, 2000000, Limits(8, 4096, 4096), 0), (10, 90, Limits(8, 4096, 4096), 20), (10, 90, Limits(8, 4096, 1), 0), (10, 90, Limits(8, 4096, 4096), 0)]
    out = None
    for i, (after, target, limits, floor) in enumerate(asked, 1):
        row = records.page_refusal(e, after, target, limits, _size(), floor).select(F.lit(i).alias("asked"), "refusal")
        out = row if out is None else out.unionByName(row)
    return out


@_register("record_page_late_payload", f"""
WITH p AS (SELECT * FROM ({_EVENT}) WHERE position > 200 AND position <= 600 ORDER BY position LIMIT 64),
r AS (SELECT *, CAST(strlen(payload) AS BIGINT) AS size, sum(strlen(payload)) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING) AS running FROM p),
c AS (SELECT *, {_CUT.format(record=512, total=1024, over='ORDER BY position')} AS cut FROM r)
SELECT position, record_id, payload FROM c WHERE cut = 0""")
def record_page_late_payload(spark, sf):
    e = B.event_records(spark, sf)
    sized = records.Positioned(e.df.withColumn("size", _size()), e.raw, e.shift)
    return records.page_late(sized, 200, 600, Limits(64, 1024, 512), "size", "payload").select("position", "record_id", "payload")




@_register("record_open_page", f"""
WITH e AS ({_EVENT}), h AS (SELECT max(position) AS head FROM e),
p AS (SELECT e.*, head FROM e, h WHERE position > 900 AND position <= head ORDER BY position LIMIT 32),
r AS (SELECT *, CAST(strlen(payload) AS BIGINT) AS size, sum(strlen(payload)) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING) AS running FROM p),
c AS (SELECT *, {_CUT.format(record=256, total=640, over='ORDER BY position')} AS cut FROM r)
SELECT head, position, size FROM c WHERE cut = 0""")
def record_open_page(spark, sf):
    e = B.event_records(spark, sf)
    head = e.head().first()["head"]
    rows = records.page(e, 900, head, Limits(32, 640, 256), _size())
    return rows.select(F.lit(head).cast("bigint").alias("head"), "position", _size().alias("size"))


@_register("record_pages_greedy", """
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id + 1 AS position, CAST(strlen(text) AS BIGINT) AS size, sum(strlen(text)) OVER (ORDER BY doc_id) AS total FROM documents),
n AS MATERIALIZED (SELECT a.position, greatest(a.position, least(a.position + 7, (SELECT max(position) FROM d), (SELECT coalesce(max(b.position), 0) FROM d b WHERE b.position BETWEEN a.position AND a.position + 7 AND b.total <= a.total - a.size + 12000))) AS last FROM d a),
w AS (SELECT 1 AS page, position AS first_position, last AS last_position FROM n WHERE position = 1
  UNION ALL SELECT page + 1, n.position, n.last FROM w JOIN n ON n.position = w.last_position + 1)
SELECT CAST(page AS BIGINT) AS page, first_position, last_position, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes
FROM w JOIN d ON d.position BETWEEN first_position AND last_position GROUP BY ALL""")
def record_pages_greedy(spark, sf):
    rows = B.document_records(spark, sf).all().select("position", "size")
    return records.greedy_pages(rows, Limits(8, 12000, 12000)).select("page", "first_position", "last_position", "records", "bytes")


@_register("replica_cached_read", f"""
WITH p AS (SELECT * FROM ({_EVENT}) WHERE position > 250 AND position <= least(300, 400) ORDER BY position LIMIT 128),
r AS (SELECT *, CAST(strlen(payload) AS BIGINT) AS size, sum(strlen(payload)) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING) AS running FROM p),
c AS (SELECT *, {_CUT.format(record=4096, total=65536, over='ORDER BY position')} AS cut FROM r)
SELECT position, record_id, payload FROM c WHERE cut = 0""")
def replica_cached_read(spark, sf):
    checkpoint = 300
    rows = records.page(B.event_records(spark, sf), 250, min(400, checkpoint), Limits(128, 65536, 4096), _size())
    return rows.select("position", "record_id", "payload")




def _altered(e: DataFrame) -> DataFrame:
    return e.withColumn("payload", F.when(F.col("position") % 17 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))










# --- history ---------------------------------------------------------------

@_register("tail_per_stream", f"""
WITH t AS (SELECT conv_id, position, strlen(payload) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY position DESC) AS r FROM ({_TURN})),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY position DESC ROWS UNBOUNDED PRECEDING) AS running FROM t WHERE r <= 4),
c AS (SELECT *, {_CUT.format(record=500, total=600, over='PARTITION BY conv_id ORDER BY position DESC')} AS cut FROM s)
SELECT conv_id, min(position) FILTER (WHERE cut = 0) AS first, max(position) AS watermark, count(*) FILTER (WHERE cut = 0) AS records,
  CAST(coalesce(sum(size) FILTER (WHERE cut = 0), 0) AS BIGINT) AS bytes, CASE WHEN count(*) FILTER (WHERE cut = 0) = 0 THEN 'OversizedRecord' END AS refusal FROM c GROUP BY conv_id""")
def tail_per_stream(spark, sf):
    return history.tails(B.turns(spark, sf), "conv_id", "position", _size(), Limits(4, 600, 500))


_OLDER = f"""
o AS (SELECT *, strlen(payload) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY position DESC) AS r FROM ({_TURN}) WHERE position < 6),
os AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY position DESC ROWS UNBOUNDED PRECEDING) AS running FROM o WHERE r <= 3),
oc AS (SELECT *, {_CUT.format(record=2000, total=2000, over='PARTITION BY conv_id ORDER BY position DESC')} AS cut FROM os)"""


def _older(spark, sf):
    return history.older_pages(B.turns(spark, sf), "conv_id", "position", F.lit(6), _size(), Limits(3, 2000, 2000))


@_register("older_page", f"WITH {_OLDER} SELECT conv_id, position, record_id, CAST(size AS BIGINT) AS size FROM oc WHERE cut = 0")
def older_page(spark, sf):
    return _older(spark, sf).select("conv_id", "position", "record_id", _size().alias("size"))


@_register("older_missing_prefix", f"WITH {_OLDER} SELECT conv_id, position, record_id FROM oc WHERE cut = 0 AND position < 4")
def older_missing_prefix(spark, sf):
    saved = B.turns(spark, sf).filter("position >= 4")
    return history.missing_prefix(_older(spark, sf), saved, ["conv_id", "position"]).select("conv_id", "position", "record_id")


@_register("older_overlap_conflicts", f"WITH {_OLDER} SELECT conv_id, position FROM oc WHERE cut = 0 AND position >= 3 AND conv_id % 9 = 0")
def older_overlap_conflicts(spark, sf):
    saved = B.turns(spark, sf).filter("position >= 3").withColumn("payload", F.when(F.col("conv_id") % 9 == 0, F.concat("payload", F.lit("?"))).otherwise(F.col("payload")))
    return history.overlap_conflicts(_older(spark, sf), saved, ["conv_id", "position"]).select("conv_id", "position")


def _progress(spark, sf):
    heads = B.table(spark, sf, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("live_head"))
    return heads.select("conv_id", "live_head", F.greatest(F.lit(1), F.col("live_head") - 3).alias("lower_bound"), (F.col("conv_id") % 7 == 0).alias("deleted"), (F.col("conv_id") % 5 != 0).alias("loaded"))


_PROGRESS = "SELECT conv_id, max(turn) + 1 AS live_head, greatest(1, max(turn) + 1 - 3) AS lower_bound, conv_id % 7 = 0 AS deleted, conv_id % 5 <> 0 AS loaded FROM conversations GROUP BY conv_id"


@_register("history_read_state", f"""
SELECT conv_id, CASE WHEN NOT loaded THEN 'not_loaded' WHEN deleted THEN 'deleted' WHEN live_head = 0 THEN 'complete_empty' WHEN lower_bound = 1 THEN 'complete' ELSE 'partial' END AS state FROM ({_PROGRESS})""")
def history_read_state(spark, sf):
    p = _progress(spark, sf)
    return p.select("conv_id", history.read_state(F.col("deleted"), F.col("live_head"), F.col("lower_bound"), F.col("loaded")).alias("state"))


@_register("history_state_join", f"""
SELECT s.conv_id, s.position, h.lower_bound, h.deleted FROM (SELECT conv_id, max(turn) + 1 AS position FROM conversations GROUP BY conv_id) s JOIN ({_PROGRESS}) h USING (conv_id) WHERE h.loaded""")
def history_state_join(spark, sf):
    streams = B.table(spark, sf, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("position"))
    return streams.join(_progress(spark, sf).filter("loaded"), "conv_id").select("conv_id", "position", "lower_bound", "deleted")




# --- catalogues ------------------------------------------------------------

_FOLD = """
log AS (SELECT event_id AS seq, 'u' || user_id AS entry_id, event_type = 'error' AND user_id % 3 = 0 AS is_del, event_type || '|' || coalesce(props, '') AS payload FROM events),
prior AS (SELECT *, last_value(CASE WHEN NOT is_del THEN payload END IGNORE NULLS) OVER (PARTITION BY entry_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM log),
fence AS (SELECT *, coalesce(sum(CASE WHEN is_del AND prev IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY entry_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dead FROM prior),
told AS (SELECT seq, entry_id, is_del, payload, CASE WHEN dead > 0 THEN 'fenced' WHEN is_del AND prev IS NULL THEN 'missing' WHEN NOT is_del AND prev = payload THEN 'quiet' ELSE 'accepted' END AS outcome FROM fence),
m AS (SELECT *, row_number() OVER (ORDER BY seq) AS revision FROM told WHERE outcome = 'accepted')"""


def _state_sql(name: str, upto: str | None = None) -> str:
    where = f" WHERE revision <= {upto}" if upto else ""
    return f"""{name} AS (SELECT entry_id, min(revision) AS creation, max(revision) AS revision, bool_or(is_del) AS deleted,
 CASE WHEN NOT bool_or(is_del) THEN arg_max(payload, revision) END AS payload FROM m{where} GROUP BY entry_id)"""


#: A revision that is this part of the log's length.
_PART = "(SELECT count(*) // {} FROM events)"


def _part(spark, sf, n: int) -> int:
    return B.table(spark, sf, "events").count() // n


def _mutations(spark, sf):
    return catalogue.accepted(B.mutation_log(spark, sf))


_ENTRY = ["entry_id", "creation", "revision", "deleted", "payload"]


@_register("catalogue_current", f"WITH {_FOLD}, {_state_sql('c')} SELECT entry_id, creation, revision, deleted, payload FROM c")
def catalogue_current(spark, sf):
    return catalogue.current(_mutations(spark, sf)).select(*_ENTRY)


@_register("catalogue_outcomes", f"WITH {_FOLD} SELECT outcome, count(*) AS mutations FROM told GROUP BY outcome")
def catalogue_outcomes(spark, sf):
    return catalogue.outcomes(B.mutation_log(spark, sf)).groupBy("outcome").agg(F.count("*").alias("mutations"))


@_register("catalogue_noop_writes", f"WITH {_FOLD} SELECT seq, entry_id FROM told WHERE outcome = 'quiet'")
def catalogue_noop_writes(spark, sf):
    return catalogue.outcomes(B.mutation_log(spark, sf)).filter("outcome = 'quiet'").select("seq", "entry_id")


@_register("catalogue_refused_after_fence", f"WITH {_FOLD} SELECT seq, entry_id, is_del FROM told WHERE outcome = 'fenced'")
def catalogue_refused_after_fence(spark, sf):
    return catalogue.outcomes(B.mutation_log(spark, sf)).filter("outcome = 'fenced'").select("seq", "entry_id", "is_del")


_PROBE = "probe AS (SELECT entry_id, creation, revision, deleted FROM c WHERE creation <= 600 AND revision > 100 AND (creation > 3 OR (creation = 3 AND entry_id > 'u2')) ORDER BY creation, entry_id LIMIT 9)"


def _probe(spark, sf):
    return catalogue.manifest(catalogue.current(_mutations(spark, sf)), 600, 100, (3, "u2"), 8)


@_register("catalogue_manifest_page", f"WITH {_FOLD}, {_state_sql('c')}, {_PROBE} SELECT * FROM probe ORDER BY creation, entry_id LIMIT 8")
def catalogue_manifest_page(spark, sf):
    return catalogue.manifest_page(_probe(spark, sf), 8)


@_register("catalogue_has_more", f"WITH {_FOLD}, {_state_sql('c')}, {_PROBE} SELECT count(*) > 8 AS has_more, least(count(*), 8) AS entries FROM probe")
def catalogue_has_more(spark, sf):
    return catalogue.has_more(_probe(spark, sf), 8)


@_register("catalogue_classify_unchanged", f"""WITH {_FOLD}, {_state_sql('c')}, {_state_sql('k', _PART.format(2))}
SELECT c.entry_id, c.revision, k.revision AS cached_revision, CASE WHEN k.revision >= c.revision THEN 'unchanged' ELSE 'resolve' END AS action
FROM (SELECT * FROM c ORDER BY creation, entry_id LIMIT 100) c LEFT JOIN k USING (entry_id)""")
def catalogue_classify_unchanged(spark, sf):
    m = _mutations(spark, sf)
    page = catalogue.manifest_page(catalogue.current(m), 100)
    return catalogue.classify(page, catalogue.as_of(m, _part(spark, sf, 2))).select("entry_id", "revision", "cached_revision", "action")




@_register("catalogue_merge_newest_wins", f"""WITH {_FOLD}, {_state_sql('a', _PART.format(4))}, {_state_sql('b', _PART.format(2))}
SELECT coalesce(b.entry_id, a.entry_id) AS entry_id, coalesce(b.creation, a.creation) AS creation, coalesce(b.revision, a.revision) AS revision, coalesce(b.deleted, a.deleted) AS deleted,
 CASE WHEN b.entry_id IS NOT NULL THEN b.payload ELSE a.payload END AS payload FROM a FULL JOIN b ON a.entry_id = b.entry_id""")
def catalogue_merge_newest_wins(spark, sf):
    m = _mutations(spark, sf)
    return catalogue.merge(catalogue.as_of(m, _part(spark, sf, 2)), catalogue.as_of(m, _part(spark, sf, 4))).select(*_ENTRY)


@_register("catalogue_page_cover", f"""WITH {_FOLD}, {_state_sql('c')}, {_state_sql('k', _PART.format(2))},
p AS (SELECT c.entry_id, c.creation, coalesce(k.revision >= c.revision, false) AS same FROM (SELECT * FROM c ORDER BY creation, entry_id LIMIT 100) c LEFT JOIN k USING (entry_id))
SELECT count(*) FILTER (WHERE (NOT same AND creation % 3 = 0) OR (same AND creation % 5 = 0 AND creation % 3 <> 0)) AS uncovered,
 count(*) FILTER (WHERE NOT same AND creation % 7 = 1 AND creation % 3 <> 0) AS foreign_ids, CAST(0 AS BIGINT) AS repeated FROM p""")
def catalogue_page_cover(spark, sf):
    """A page of which some ids are not resolved, some unchanged ones are resolved as well, and some resolved ids are foreign."""
    m = _mutations(spark, sf)
    page = catalogue.manifest_page(catalogue.current(m), 100)
    told = catalogue.classify(page, catalogue.as_of(m, _part(spark, sf, 2)))
    resolved = told.filter("action = 'resolve' AND creation % 3 <> 0").select("entry_id")
    foreign = told.filter("action = 'resolve' AND creation % 7 = 1 AND creation % 3 <> 0").select(F.concat(F.lit("foreign-"), "entry_id").alias("entry_id"))
    kept = told.filter("action = 'unchanged'")
    twice = kept.filter("creation % 5 = 0 AND creation % 3 <> 0").select("entry_id")
    return catalogue.page_cover(page, resolved.unionByName(foreign).unionByName(twice), kept.select("entry_id"))


@_register("catalogue_reset_survivors", f"WITH {_FOLD}, {_state_sql('c')} SELECT entry_id, creation, revision FROM c WHERE deleted")
def catalogue_reset_survivors(spark, sf):
    return catalogue.reset_survivors(catalogue.current(_mutations(spark, sf))).select("entry_id", "creation", "revision")


def _collected(spark, sf):
    c = catalogue.current(_mutations(spark, sf)).withColumn("visible", F.lit(True))
    return catalogue.collect(c, 500, 0, 500)


@_register("catalogue_horizon_visible", f"WITH {_FOLD}, {_state_sql('c')} SELECT NOT (deleted AND revision < 500) AS visible, deleted, count(*) AS entries FROM c GROUP BY ALL")
def catalogue_horizon_visible(spark, sf):
    return _collected(spark, sf).groupBy("visible", "deleted").agg(F.count("*").alias("entries"))


_RECEIVERS = "SELECT 'u' || user_id AS receiver, max(event_id) + 1 AS completed, max(event_id) + 100 AS boundary, user_id % 2 = 0 AS full_reset FROM events GROUP BY user_id"


@_register("catalogue_coverage_expired", f"SELECT receiver, base, base < 900 AS expired FROM (SELECT receiver, CASE WHEN full_reset THEN boundary ELSE completed END AS base FROM ({_RECEIVERS}))")
def catalogue_coverage_expired(spark, sf):
    e = B.table(spark, sf, "events").groupBy("user_id").agg((F.max("event_id") + 1).alias("completed"), (F.max("event_id") + 100).alias("boundary"))
    receivers = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("receiver"), "completed", "boundary", (F.col("user_id") % 2 == 0).alias("full_reset"))
    return catalogue.coverage(receivers, 900).select("receiver", "base", "expired")


@_register("catalogue_compaction_batch", f"WITH {_FOLD}, {_state_sql('c')} SELECT entry_id, creation, revision FROM c WHERE deleted AND revision < 500 ORDER BY revision, entry_id LIMIT 12")
def catalogue_compaction_batch(spark, sf):
    return catalogue.compaction_batch(_collected(spark, sf), 500, 12)


def _pending(m: DataFrame, upto: int) -> DataFrame:
    return catalogue.as_of(m, upto).filter("NOT deleted").withColumn("revision", F.col("revision") + F.when(F.col("creation") % 2 == 0, 5000).otherwise(0))


_PENDING = "pending AS (SELECT entry_id, creation, revision + CASE WHEN creation % 2 = 0 THEN 5000 ELSE 0 END AS revision FROM q WHERE NOT deleted)"


@_register("recovery_candidate_floors", f"""WITH {_FOLD}, {_state_sql('c')}, {_state_sql('q', _PART.format(4))}, {_PENDING}
SELECT entry_id, min(creation) AS creation, max(revision) AS revision FROM (SELECT entry_id, creation, revision FROM c WHERE NOT deleted UNION ALL SELECT * FROM pending) GROUP BY entry_id""")
def recovery_candidate_floors(spark, sf):
    m = _mutations(spark, sf)
    return catalogue.candidate_floors(catalogue.current(m), _pending(m, _part(spark, sf, 4))).select("entry_id", "creation", "revision")


@_register("recovery_creation_conflicts", f"""WITH {_FOLD}, {_state_sql('c')}, {_state_sql('q', _PART.format(4))}, {_PENDING}
SELECT count(*) FILTER (WHERE p.creation + CASE WHEN p.creation % 3 = 0 THEN 1 ELSE 0 END <> c.creation) AS conflicts FROM pending p JOIN c USING (entry_id)""")
def recovery_creation_conflicts(spark, sf):
    m = _mutations(spark, sf)
    skewed = _pending(m, _part(spark, sf, 4)).withColumn("creation", F.col("creation") + F.when(F.col("creation") % 3 == 0, 1).otherwise(0))
    return catalogue.creation_conflicts(skewed, catalogue.current(m))


@_register("recovery_highest_revision", f"WITH {_FOLD}, {_state_sql('c')}, {_state_sql('q', _PART.format(4))}, {_PENDING} SELECT coalesce(max(revision), 0) AS highest FROM (SELECT revision FROM c UNION ALL SELECT revision FROM pending)")
def recovery_highest_revision(spark, sf):
    m = _mutations(spark, sf)
    return catalogue.highest_revision(catalogue.current(m), _pending(m, _part(spark, sf, 4)))


@_register("recovery_remaining", f"""WITH {_FOLD}, {_state_sql('c')}, {_state_sql('q', _PART.format(4))}, {_PENDING}
SELECT entry_id, creation, revision FROM pending WHERE entry_id NOT IN (SELECT entry_id FROM c ORDER BY creation, entry_id LIMIT 5)""")
def recovery_remaining(spark, sf):
    m = _mutations(spark, sf)
    return catalogue.remaining(_pending(m, _part(spark, sf, 4)), catalogue.manifest_page(catalogue.current(m), 5)).select("entry_id", "creation", "revision")


# --- artifacts -------------------------------------------------------------

@_register("artifact_identity", "SELECT doc_id AS artifact_id, CAST(strlen(text) AS BIGINT) AS length, sha256(text) AS digest FROM documents")
def artifact_identity(spark, sf):
    return artifacts.identities(B.artifacts(spark, sf))


_CHUNKS = "SELECT doc_id AS artifact_id, o AS \"offset\", encode(text)[o + 1 : o + 4096] AS bytes FROM documents, unnest(range(0, CAST(strlen(text) AS BIGINT), 4096)) AS r(o)"


@_register("artifact_chunks", f"SELECT artifact_id, \"offset\", CAST(octet_length(bytes) AS BIGINT) AS length FROM ({_CHUNKS})")
def artifact_chunks(spark, sf):
    return artifacts.chunks(B.artifacts(spark, sf), 4096).select("artifact_id", "offset", F.octet_length("bytes").cast("bigint").alias("length"))


@_register("artifact_chunk_digest", f"SELECT artifact_id, \"offset\", sha256(bytes) AS digest FROM ({_CHUNKS})")
def artifact_chunk_digest(spark, sf):
    return artifacts.chunks(B.artifacts(spark, sf), 4096).select("artifact_id", "offset", F.sha2("bytes", 256).alias("digest"))


@_register("artifact_assembly_verified", "SELECT doc_id AS artifact_id, CAST(strlen(text) AS BIGINT) AS length, sha256(text) AS digest, NOT (doc_id % 50 = 3 AND strlen(text) > 4096) AS verified FROM documents")
def artifact_assembly_verified(spark, sf):
    """Chunks of every artifact, with the second one lost of some, assembled and checked."""
    whole = B.artifacts(spark, sf)
    lost = (F.col("artifact_id") % 50 == 3) & (F.col("offset") == 4096)
    return artifacts.verify(artifacts.identities(whole), artifacts.assemble(artifacts.chunks(whole, 4096).filter(~lost))).select("artifact_id", "length", "digest", "verified")


@_register("artifact_availability", """
SELECT d.doc_id AS artifact_id, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'Deleted' WHEN d.doc_id % 3 = 0 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'CachedVerified' ELSE 'HashMismatch' END WHEN l.doc_id IS NOT NULL THEN 'MetadataOnly' ELSE 'SourceUnavailable' END AS availability
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def artifact_availability(spark, sf):
    ids = artifacts.identities(B.artifacts(spark, sf))
    marks = B.table(spark, sf, "labels").select(F.col("doc_id").alias("artifact_id"), "toxic", F.lit(True).alias("known"))
    local = F.when(F.col("artifact_id") % 3 == 0, F.when(F.col("artifact_id") % 2 == 0, F.col("digest")).otherwise(F.lit("00")))
    rows = ids.join(marks, "artifact_id", "left")
    state = artifacts.availability(F.coalesce(F.col("toxic"), F.lit(0)) == 1, local, F.col("digest"), F.coalesce("known", F.lit(False)))
    return rows.select("artifact_id", state.alias("availability"))


@_register("artifact_revoked_filter", "SELECT doc_id AS artifact_id, CAST(strlen(text) AS BIGINT) AS length FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def artifact_revoked_filter(spark, sf):
    revoked = B.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("artifact_id"))
    return artifacts.without_revoked(artifacts.identities(B.artifacts(spark, sf)), revoked, ["artifact_id"]).select("artifact_id", "length")


# --- retention, capabilities, epochs, hints --------------------------------

_PINS = "SELECT user_id % 4 AS resource, 'u' || user_id AS holder, max(event_id) + 1 AS completed, (max(event_id) + 1) % 97 AS expires_at_ms FROM events GROUP BY user_id"


@_register("retention_live_pins", f"SELECT * FROM ({_PINS}) WHERE expires_at_ms > 48")
def retention_live_pins(spark, sf):
    return retention.live_pins(B.pins(spark, sf), 48)


@_register("retention_cutoff", f"""
WITH p AS ({_PINS}), w AS (SELECT resource, (SELECT max(event_id) + 1 FROM events) AS head, 10 + resource AS floor, (SELECT max(event_id) + 1 FROM events) - 5 AS preferred, CASE WHEN resource = 2 THEN 700 END AS forced FROM (SELECT DISTINCT resource FROM p)),
h AS (SELECT resource, min(completed) AS held FROM p WHERE expires_at_ms > 48 GROUP BY resource)
SELECT resource, greatest(least(preferred, coalesce(held, preferred)), floor, coalesce(forced, floor)) AS cutoff FROM w LEFT JOIN h USING (resource)""")
def retention_cutoff(spark, sf):
    p = B.pins(spark, sf)
    head = B.event_records(spark, sf).head()
    windows = p.select("resource").distinct().join(F.broadcast(head)).select(  # the head is one row
        "resource", "head", (F.col("resource") + 10).alias("floor"), (F.col("head") - 5).alias("preferred"), F.when(F.col("resource") == 2, F.lit(700).cast("bigint")).alias("forced")
    )
    return retention.cutoffs(windows, p, ["resource"], 48).select("resource", "cutoff")


@_register("retention_readable_range", "SELECT count(*) AS records, min(event_id) + 1 AS first, max(event_id) + 1 AS last FROM events WHERE event_id + 1 > 640")
def retention_readable_range(spark, sf):
    rows = B.event_records(spark, sf)
    kept = retention.readable(rows.df, "event_id", 640 - rows.shift)
    return kept.agg(F.count("*").alias("records"), (F.min("event_id") + 1).alias("first"), (F.max("event_id") + 1).alias("last"))


@_register("capability_missing_bits", """
SELECT event_id, (user_id % 16) & ~5 AS missing, CASE WHEN event_id % 11 = 0 THEN 'UnsupportedVersion' WHEN ((user_id % 16) & ~5) <> 0 THEN 'MissingReader' WHEN ((event_id % 8) & ~3) <> 0 THEN 'MissingWriter' END AS refusal FROM events""")
def capability_missing_bits(spark, sf):
    e = B.table(spark, sf, "events")
    reader, writer = F.col("user_id") % 16, F.col("event_id") % 8
    version = F.when(F.col("event_id") % 11 == 0, 2).otherwise(1)
    return e.select("event_id", C.missing_bits(reader, 5).alias("missing"), C.writer_refusal(version, reader, writer, 5, 3).alias("refusal"))


_HEADS = "SELECT event_id, user_id, event_id % 7 AS origin, user_id % 3 AS incarnation, event_id % 5 AS schema_id, (event_id * 7) % 100 AS position, event_id % 4 AS reader_required, event_id % 2 AS writer_required, CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS version FROM events"


@_register("head_transition_refusal", f"""
WITH h AS ({_HEADS})
SELECT a.event_id, CASE WHEN b.version <> 1 OR a.version <> 1 THEN 'UnsupportedVersion' WHEN b.origin % 2 <> a.origin % 2 THEN 'DifferentSource' WHEN b.incarnation <> a.incarnation THEN NULL
 WHEN b.schema_id % 2 <> a.schema_id % 2 THEN 'SchemaChanged' WHEN a.position < b.position THEN 'PositionRegressed' WHEN (b.reader_required & ~a.reader_required) <> 0 OR (b.writer_required & ~a.writer_required) <> 0 THEN 'RequirementsCleared' END AS refusal
FROM h a JOIN h b ON b.event_id = a.event_id - 1""")
def head_transition_refusal(spark, sf):
    e = B.table(spark, sf, "events")
    k = F.col("event_id")
    head = F.struct(
        F.when(k % 13 == 0, 2).otherwise(1).alias("version"), ((k % 7) % 2).alias("origin"), F.lit("s").alias("stream"), (F.col("user_id") % 3).alias("incarnation"),
        ((k % 5) % 2).alias("schema_id"), (k * 7 % 100).alias("position"), (k % 4).alias("reader_required"), (k % 2).alias("writer_required"),
    )
    rows = e.select("event_id", head.alias("after"))
    before = rows.select((F.col("event_id") + 1).alias("event_id"), F.col("after").alias("before"))
    return rows.join(before, "event_id").select("event_id", C.head_transition_refusal("before", "after").alias("refusal"))


@_register("epoch_fenced_rows", """
WITH r AS (SELECT event_id, user_id % 5 AS authority, event_id // 300 AS epoch FROM events), o AS (SELECT authority, max(epoch) AS top FROM r GROUP BY authority)
SELECT event_id, r.authority, epoch FROM r JOIN o ON r.authority = o.authority AND epoch = top""")
def epoch_fenced_rows(spark, sf):
    rows = B.table(spark, sf, "events").select("event_id", (F.col("user_id") % 5).alias("authority"), F.floor(F.col("event_id") / 300).alias("epoch"))
    return projections.epoch_fenced(rows, rows)


@_register("hint_coalesced_head", """
WITH a AS (SELECT event_id // 100 AS window_no, (event_id * 37) % 997 AS head FROM events), g AS (SELECT window_no, max(head) AS head, count(*) AS hints FROM a GROUP BY window_no)
SELECT window_no, head, hints, coalesce(head > max(head) OVER (ORDER BY window_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS emitted FROM g""")
def hint_coalesced_head(spark, sf):
    k = F.col("event_id")
    arrivals = B.table(spark, sf, "events").select(F.floor(k / 100).alias("window_no"), (k * 37 % 997).alias("head"))
    return projections.coalesced_hints(arrivals, "window_no")


@_register("identity_refusals", """
WITH i AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN repeat('x', CAST(100 + event_id % 60 AS INTEGER)) WHEN 1 THEN '   ' WHEN 2 THEN repeat('é', CAST(50 + event_id % 30 AS INTEGER)) ELSE event_type END AS id FROM events)
SELECT event_id, CASE WHEN strlen(id) > 128 OR regexp_full_match(id, '[\\s\\p{Z}]*') THEN 'InvalidId' END AS refusal FROM i""")
def identity_refusals(spark, sf):
    k = F.col("event_id")
    name = (
        F.when(k % 4 == 0, F.expr("repeat('x', cast(100 + event_id % 60 AS int))")).when(k % 4 == 1, F.lit("   "))
        .when(k % 4 == 2, F.expr("repeat('é', cast(50 + event_id % 30 AS int))")).otherwise(F.col("event_type"))
    )
    return B.table(spark, sf, "events").select("event_id", C.id_refusal(name).alias("refusal"))


@_register("page_refusals", f"""
WITH e AS ({_EVENT}), r AS (SELECT (position - 1) // 16 AS page, (position - 1) % 16 + 1 AS ordinal, position + CASE WHEN ((position - 1) // 16) % 5 = 1 AND position % 16 = 9 THEN 1 ELSE 0 END AS position,
 CASE WHEN ((position - 1) // 16) % 5 = 2 AND position % 16 = 12 THEN 'twice' WHEN ((position - 1) // 16) % 5 = 2 AND position % 16 = 3 THEN 'twice' ELSE record_id END AS record_id,
 CAST(strlen(payload) AS BIGINT) AS size, NOT (((position - 1) // 16) % 5 = 3 AND position % 16 = 5) AS same_scope FROM e),
m AS (SELECT *, sum(size) OVER (PARTITION BY page ORDER BY ordinal) AS total, row_number() OVER (PARTITION BY page, record_id ORDER BY ordinal) > 1 AS repeated FROM r),
k AS (SELECT *, CASE WHEN NOT same_scope OR repeated THEN 'WrongRecord' WHEN size > 4096 THEN 'OversizedRecord' WHEN total > 400 THEN 'BoundsExceeded' WHEN position <> page * 16 + ordinal THEN 'Noncontiguous' END AS code FROM m)
SELECT page, arg_min(code, ordinal) FILTER (WHERE code IS NOT NULL) AS refusal FROM k GROUP BY page""")
def page_refusals(spark, sf):
    """Pages of 16 events, some with a gap, a repeated id or a foreign record, all against one budget."""
    p = F.col("position")
    page = F.floor((p - 1) / 16)
    rows = B.event_records(spark, sf).all().select(
        page.alias("page"), ((p - 1) % 16 + 1).alias("ordinal"), (p + F.when((page % 5 == 1) & (p % 16 == 9), 1).otherwise(0)).alias("position"),
        F.when((page % 5 == 2) & (p % 16).isin(3, 12), "twice").otherwise(F.col("record_id")).alias("record_id"),
        _size().alias("size"), (~((page % 5 == 3) & (p % 16 == 5))).alias("same_scope"),
    )
    after = F.col("page") * 16
    requests = rows.select("page").distinct().select(
        "page", after.alias("after"), (after + 16).alias("target"), F.lit(16).alias("max_records"), F.lit(400).alias("max_bytes"), F.lit(4096).alias("max_record_bytes")
    )
    return validate.pages(rows, requests)


@_register("mask_round_trip", "SELECT event_id, event_id * 65537 AS mask, lpad(lower(hex(event_id * 65537)), 16, '0') AS bytes_hex FROM events")
def mask_round_trip(spark, sf):
    rows = B.table(spark, sf, "events").select("event_id", C.mask_to_bytes(F.col("event_id") * 65537).alias("b"))
    return rows.select("event_id", C.bytes_to_mask(F.col("b")).alias("mask"), F.lower(F.hex("b")).alias("bytes_hex"))


# --- projections -----------------------------------------------------------

def _task_records(spark, sf):
    """Events as task operations in the hosts' payload format."""
    e = B.table(spark, sf, "events")
    tag = (F.col("event_id") % 4 + 17).cast("int")
    task, title = F.concat(F.lit("t"), (F.col("user_id")).cast("string")), F.concat("event_type", F.lit("-"), F.col("event_id").cast("string"))
    second = F.when(tag.isin(17, 18), C.encode_field(title)).when(tag == 19, F.unhex(F.when(F.col("event_id") % 8 == 2, "01").otherwise("00"))).otherwise(F.unhex(F.lit("")))
    return e.select((F.col("event_id") + 1).alias("position"), F.concat(F.unhex(F.hex(tag)), C.encode_field(task), second).alias("payload"))


_TASKS = """
ops AS (SELECT event_id + 1 AS position, 't' || user_id AS task, event_id % 4 AS kind, CASE WHEN event_id % 4 < 2 THEN event_type || '-' || event_id END AS title, CASE WHEN event_id % 4 = 2 THEN event_id % 8 = 2 END AS done FROM events)"""


@_register("task_board_projection", f"""WITH {_TASKS},
life AS (SELECT task, max(position) FILTER (WHERE kind = 0) AS born, max(position) FILTER (WHERE kind = 3) AS died FROM ops GROUP BY task),
mine AS (SELECT ops.* FROM ops JOIN life USING (task) WHERE born IS NOT NULL AND (died IS NULL OR died < born) AND position >= born)
SELECT task, arg_max(title, position) FILTER (WHERE title IS NOT NULL) AS title, coalesce(arg_max(done, position) FILTER (WHERE done IS NOT NULL), false) AS done FROM mine GROUP BY task""")
def task_board_projection(spark, sf):
    return projections.task_board(projections.task_operations(_task_records(spark, sf)))


@_register("task_board_violations", f"""WITH {_TASKS},
w AS (SELECT *, last_value(CASE WHEN kind IN (0, 3) THEN kind END IGNORE NULLS) OVER (PARTITION BY task ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ops)
SELECT position, task FROM w WHERE CASE WHEN kind = 0 THEN coalesce(before = 0, false) ELSE NOT coalesce(before = 0, false) END""")
def task_board_violations(spark, sf):
    return projections.task_violations(projections.task_operations(_task_records(spark, sf))).select("position", "task")


@_register("transcript_projection", """
SELECT conv_id, turn + 1 AS position, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS text FROM conversations""")
def transcript_projection(spark, sf):
    return projections.transcript(B.turns(spark, sf), "conv_id", "position", "payload")




# --- whole streams ---------------------------------------------------------
# From position 0 to the head. Saved, incoming and received sides are the lower and the upper two thirds of all positions,
# which overlap in the middle third.

_WHOLE = f"e AS ({_EVENT}), h AS (SELECT max(position) AS head, max(position) // 3 AS low, max(position) - max(position) // 3 AS high FROM e)"


def _whole(spark, sf):
    """The event records with their head and the ends of the lower and middle thirds."""
    e = B.event_records(spark, sf)
    head = e.head().first()["head"] or 0
    return e, head, head // 3, head - head // 3


@_register("record_page_density", f"WITH {_WHOLE} SELECT max(head) AS expected, count(*) AS found, count(DISTINCT position) AS distinct_positions, max(head) - count(DISTINCT position) AS gaps FROM e, h")
def record_page_density(spark, sf):
    e, head, _, _ = _whole(spark, sf)
    return records.density_gaps(e, 0, head)


@_register("replica_catchup_delta", f"WITH {_WHOLE} SELECT position, record_id, payload FROM e, h WHERE position > low")
def replica_catchup_delta(spark, sf):
    e, head, low, _ = _whole(spark, sf)
    return e.between(low, head).select("position", "record_id", "payload")


@_register("replica_conflict_ids", f"WITH {_WHOLE} SELECT position, record_id FROM e, h WHERE position > low AND position <= high AND position % 17 = 0")
def replica_conflict_ids(spark, sf):
    e, head, low, high = _whole(spark, sf)
    plan = _altered(e.between(low, head)).select("position", "record_id", "payload")
    return records.conflicting_ids(plan, e.between(0, high)).select("position", "record_id")


@_register("replica_exact_replay", f"""
WITH {_WHOLE}, a AS (SELECT count(*) AS n FROM e WHERE position % 17 = 0)
SELECT 'same' AS plan, CAST(0 AS BIGINT) AS only_plan, CAST(0 AS BIGINT) AS only_saved, true AS exact UNION ALL SELECT 'altered', n, n, n = 0 FROM a""")
def replica_exact_replay(spark, sf):
    e, head, _, _ = _whole(spark, sf)
    saved = e.between(0, head)
    same = records.is_exact_replay(saved, saved).withColumn("plan", F.lit("same"))
    other = records.is_exact_replay(_altered(saved), saved).withColumn("plan", F.lit("altered"))
    return same.unionByName(other).select("plan", "only_plan", "only_saved", "exact")


@_register("replica_append_plan", f"""
WITH {_WHOLE}
SELECT record_id, CAST(high + row_number() OVER (ORDER BY position) AS BIGINT) AS position, NULL AS refusal FROM e, h WHERE position > high
UNION ALL SELECT record_id, NULL, 'ConflictingRecord' FROM e, h WHERE position > low AND position <= high AND position % 17 = 0""")
def replica_append_plan(spark, sf):
    e, head, low, high = _whole(spark, sf)
    incoming = _altered(e.between(low, head)).select(F.col("position").alias("seq"), "record_id", "payload")
    return records.append_plan(incoming, e.between(0, high), high).select("record_id", "position", "refusal")


@_register("wire_duplicate_bytes", f"""
WITH {_WHOLE}, a AS (SELECT position, high, strlen(payload) AS size FROM e, h WHERE position <= high UNION ALL SELECT position, high, strlen(payload) FROM e, h WHERE position > low)
SELECT CAST(coalesce(sum(size) FILTER (WHERE position <= high), 0) AS BIGINT) AS duplicate_bytes, count(*) FILTER (WHERE position <= high) AS duplicate_records, CAST(coalesce(sum(size), 0) AS BIGINT) AS payload_bytes FROM a""")
def wire_duplicate_bytes(spark, sf):
    e, head, low, high = _whole(spark, sf)
    received = e.between(0, high).unionByName(e.between(low, head)).select("position", _size().alias("size"))
    return records.duplicate_bytes(received, high)


@_register("catalogue_resolve_latest", f"WITH {_FOLD}, {_state_sql('c')} SELECT entry_id, creation, revision, deleted, payload FROM c WHERE entry_id IN (SELECT entry_id FROM log)")
def catalogue_resolve_latest(spark, sf):
    c = catalogue.current(_mutations(spark, sf))
    retired = F.col("deleted") & (F.col("revision") < 400)
    return catalogue.resolve(B.mutation_log(spark, sf), c.filter(~retired), c.filter(retired)).select(*_ENTRY)


@_register("global_rank", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS place FROM events")
def global_rank(spark, sf):
    return ordering.with_rank(B.table(spark, sf, "events").select("event_id"), "event_id", "place", 512)


@_register("hydration_targets", f"""
SELECT conv_id, min(turn + 1) FILTER (WHERE turn + 1 < lower_bound) AS next_target, count(*) FILTER (WHERE turn + 1 < lower_bound) AS waiting, count(*) FILTER (WHERE turn + 1 >= lower_bound) AS resolved
FROM conversations JOIN ({_PROGRESS}) p USING (conv_id) GROUP BY conv_id""")
def hydration_targets(spark, sf):
    needs = B.table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("lower_target"))
    return history.next_targets(needs, _progress(spark, sf), "conv_id")


# --- durable tables --------------------------------------------------------

def _scratch(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@_register("stream_follow_catchup", _EVENT)
def stream_follow_catchup(spark, sf):
    """Event records arrive as files and are followed twice; the second run finds nothing new."""
    base = _scratch(spark, "follow")
    rows = B.event_records(spark, sf).all().select("position", "record_id", F.col("payload").cast("binary").alias("payload"))
    rows.repartitionByRange(4, "position").write.parquet(f"{base}/in")
    target = CommitLog(spark, f"{base}/replica", "record-replica", RECORDS)
    for _ in range(2):
        follow(spark, f"{base}/in", rows.schema, target, f"{base}/progress", max_files=1)
    return target.read().select("position", "record_id", F.col("payload").cast("string").alias("payload"))


def _two_writers(spark, e, first, second):
    log = CommitLog(spark, f"{_scratch(spark, 'log')}/t", "record-source", RECORDS)
    at = log.snapshot()
    log.commit(at, {"head": first}, e.between(0, first))
    try:
        log.commit(at, {"head": second}, e.between(0, second))
        lost = "none"
    except Refusal as refusal:
        lost = refusal.code
    now = log.snapshot()
    seen = log.read(now).agg(F.count("*").alias("records"), F.max("position").alias("head"))
    return seen.select(F.lit(now.version).alias("version"), F.lit(lost).alias("second_writer"), "records", "head")




@_register("commitlog_cas", "SELECT CAST(1 AS BIGINT) AS version, 'Stale' AS second_writer, count(*) AS records, max(event_id) + 1 AS head FROM events")
def commitlog_cas(spark, sf):
    """Two writers of the whole stream from one snapshot: one commits, the other is stale and leaves no row."""
    e, head, _, high = _whole(spark, sf)
    return _two_writers(spark, e, head, high)
