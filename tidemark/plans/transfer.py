"""Artifact transfer: one chunk at a time, published after a last look at the manifest; or all that is missing of many artifacts in one job."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import artifacts
from tidemark.schema import MAX_CHUNK_BYTES, STAGED, Refusal
from tidemark.sources.ports import ChunkSource, TransferStore
from tidemark.sources.tables import ArtifactCache, ArtifactTable


def check_chunk(manifest: dict, offset: int, size: int, data: bytes) -> None:
    """Refuse a chunk that was not to be asked for, or has another length than the artifact leaves it."""
    if manifest["deleted"] or manifest["revision"] <= 0 or not 0 < size <= MAX_CHUNK_BYTES or not 0 <= offset < manifest["length"]:
        raise Refusal("InvalidRequest")
    if len(data) != min(size, manifest["length"] - offset):
        raise Refusal("WrongLength")


def transfer_one(artifact_id: str, size: int, source: ChunkSource, cache: TransferStore) -> dict:
    """Accept the current manifest, then fetch and stage the next chunk if one is missing."""
    if not 0 < size <= MAX_CHUNK_BYTES:
        raise Refusal("InvalidRequest")
    m = source.manifest(artifact_id)
    state = cache.accept(artifact_id, m["revision"], m["length"], m["digest"], m["deleted"])
    if state["deleted"] or state["next"] >= state["length"]:
        return state
    data = source.chunk(artifact_id, m["revision"], state["next"], size)
    check_chunk(state, state["next"], size, data)
    return cache.append(artifact_id, state["next"], data)


def publish_if_current(artifact_id: str, source: ChunkSource, cache: TransferStore) -> dict:
    """Publish what is staged only if the source still names it; a newer or deleted state is taken first."""
    m = source.manifest(artifact_id)
    state = cache.accept(artifact_id, m["revision"], m["length"], m["digest"], m["deleted"])
    if state["deleted"]:
        return state
    if state["next"] < state["length"]:
        raise Refusal("Incomplete")
    return cache.publish(artifact_id)


def transfer_all(source: ArtifactTable, cache: ArtifactCache, ids: DataFrame | None = None) -> DataFrame:
    """Bring a cache up to a source, all artifacts or those in ``ids`` (``artifact_id``), and publish them, in one commit.

    Manifests are taken by the rules of a single one. What is staged of an artifact is a prefix, so what is missing is the rest of its
    length: chunks that lie in the prefix are left out, one that begins there is cut. One aggregation hashes staged and fetched bytes in
    order, artifact by artifact, and decides whether an artifact counts as verified or what is staged of it is dropped.
    Returns ``artifact_id``, ``revision``, ``fetched`` (bytes) and ``outcome``: verified, mismatch, deleted, unchanged, or a refusal.
    """
    pinned, at = source.log.snapshot(), cache.log.snapshot()
    if at.state.get("revoked"):
        raise Refusal("Revoked")
    told = source.manifests(pinned)
    if ids is not None:
        told = told.join(ids.select("artifact_id").distinct(), "artifact_id", "left_semi")
    saved = cache.index(at).select("artifact_id", *[F.col(c).alias(f"s_{c}") for c in ("revision", "deleted", "length", "digest", "next", "verified", "dropped")])
    state = lambda gone, length, digest: F.when(gone, "deleted").otherwise(F.concat_ws(":", length.cast("string"), digest))
    now, then = [[F.col(p + c) for c in ("deleted", "length", "digest")] for p in ("", "s_")]
    refusal = artifacts.manifest_refusal(F.lit(True), F.col("revision"), state(*now), F.col("s_revision"), F.when(F.col("s_revision").isNotNull(), state(*then)))
    same = F.coalesce(F.col("s_revision") == F.col("revision"), F.lit(False))
    plan = told.join(saved, "artifact_id", "left").select(
        "artifact_id", "revision", "deleted", "length", "digest", refusal.alias("refusal"), same.alias("same"),
        F.when(same, F.col("s_next")).otherwise(0).cast("bigint").alias("have"), F.coalesce("s_dropped", F.lit(0)).alias("dropped"),
        (same & F.coalesce("s_verified", F.lit(False))).alias("whole"),
    ).persist()
    try:
        wanted = plan.filter("refusal IS NULL AND NOT deleted AND NOT whole")
        stored = source.log.read(pinned).filter("offset IS NOT NULL").select("artifact_id", "revision", "offset", "bytes")
        missing = stored.join(wanted.select("artifact_id", "revision", "have"), ["artifact_id", "revision"]).filter(F.col("offset") + F.octet_length("bytes") > F.col("have"))
        inside = F.greatest(F.col("have") - F.col("offset"), F.lit(0).cast("bigint"))
        pieces = missing.select("artifact_id", "revision", (F.col("offset") + inside).alias("offset"), F.substring("bytes", (inside + 1).cast("int"), F.lit(MAX_CHUNK_BYTES)).alias("bytes"))
        staged = cache.log.read(at).filter("kind = 'chunk'").join(wanted.filter("same").select("artifact_id", "revision", "dropped"), ["artifact_id", "revision"]).filter("version > dropped")
        whole = staged.select("artifact_id", "offset", "bytes").unionByName(pieces.select("artifact_id", "offset", "bytes"))
        checked = artifacts.verify(wanted.select("artifact_id", "revision", "length", "digest"), artifacts.assemble(whole)).select("artifact_id", "revision", "verified").persist()
        try:
            n = checked.count()
            taken = plan.filter("refusal IS NULL AND NOT same")
            if n or not taken.isEmpty():
                new = {"version": F.lit(at.version + 1).cast("bigint")}
                rows = [
                    taken.withColumn("kind", F.lit("manifest")),
                    pieces.withColumn("kind", F.lit("chunk")),
                    checked.withColumn("kind", F.when(F.col("verified"), "verified").otherwise("dropped")),
                ]
                shaped = [r.withColumns(new).select(*[(F.col(f.name) if f.name in r.columns or f.name in new else F.lit(None)).cast(f.dataType).alias(f.name) for f in STAGED]) for r in rows]
                cache.log.commit(at, at.state, shaped[0].unionByName(shaped[1]).unionByName(shaped[2]))
            fate = F.coalesce("refusal", F.when(F.col("deleted"), "deleted").when(F.col("whole"), "unchanged").when(F.col("verified"), "verified").otherwise("mismatch"))
            out = plan.join(checked.select("artifact_id", "verified"), "artifact_id", "left")
            fetched = F.when(F.col("verified").isNotNull(), F.col("length") - F.col("have")).otherwise(0).cast("bigint")
            # Written while the plan is at hand, so that whoever reads it does not compute it again.
            path = f"{cache.log.path}/told/{uuid.uuid4().hex}"
            out = out.select("artifact_id", "revision", fetched.alias("fetched"), fate.alias("outcome"))
            out.write.parquet(path)
            return cache.spark.read.schema(out.schema).parquet(path)
        finally:
            checked.unpersist()
    finally:
        plan.unpersist()
