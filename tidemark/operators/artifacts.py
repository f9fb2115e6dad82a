"""Content-addressed artifacts: identities, chunks, assembly, verification, availability, revocation."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.schema import MAX_CHUNK_BYTES, Refusal


def identities(artifacts: DataFrame, payload: str = "payload") -> DataFrame:
    """The artifacts with ``length`` and ``digest`` (hex) of their complete bytes, without the bytes."""
    return artifacts.withColumns({"length": F.octet_length(payload).cast("bigint"), "digest": F.sha2(F.col(payload).cast("binary"), 256)}).drop(payload)


def chunk_ranges(length: Column, size: int) -> Column:
    """Offsets of an artifact's chunks; none for an empty one."""
    if not 0 < size <= MAX_CHUNK_BYTES:
        raise Refusal("InvalidRequest")
    return F.when(length > 0, F.sequence(F.lit(0).cast("bigint"), length - 1, F.lit(size).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def chunks(artifacts: DataFrame, size: int = MAX_CHUNK_BYTES, key: str = "artifact_id", payload: str = "payload") -> DataFrame:
    """``artifact_id``, ``offset``, ``bytes``: exact ranges of the bytes, made without a shuffle."""
    data = F.col(payload).cast("binary")
    rows = artifacts.select(F.col(key).alias("artifact_id"), data.alias("__b"), F.explode(chunk_ranges(F.octet_length(data).cast("bigint"), size)).alias("offset"))
    return rows.select("artifact_id", "offset", F.substring("__b", (F.col("offset") + 1).cast("int"), F.lit(size)).alias("bytes"))


def chunk_refusal(offset: Column, asked: Column, length: Column, got: Column, same_request: Column, live: Column) -> Column:
    """Why a chunk reply is refused, or null; the last chunk is as short as the artifact leaves it."""
    return (
        F.when(~live | (asked <= 0) | (asked > MAX_CHUNK_BYTES) | (offset >= length), "InvalidRequest")
        .when(~same_request, "WrongRequest")
        .when(got != F.least(asked, length - offset), "WrongLength")
    )


def manifest_refusal(same_key: Column, revision: Column, state: Column, saved_revision: Column, saved_state: Column) -> Column:
    """Why a manifest may not replace a saved one; state is ``deleted`` or the content's digest."""
    return (
        F.when(~same_key, "Foreign")
        .when(revision <= 0, "InvalidRevision")
        .when(saved_revision.isNull(), None)
        .when((saved_state == "deleted") & (state != "deleted"), "Fenced")
        .when(revision < saved_revision, "Stale")
        .when((revision == saved_revision) & (state != saved_state), "Conflict")
    )


def manifest_verdict(saved: dict | None, revision: int, length: int, digest: str, deleted: bool) -> str | None:
    """The same rules for one manifest."""
    if revision <= 0:
        return "InvalidRevision"
    if saved is None:
        return None
    if saved["deleted"] and not deleted:
        return "Fenced"
    if revision < saved["revision"]:
        return "Stale"
    same = deleted == saved["deleted"] and (deleted or (length, digest) == (saved["length"], saved["digest"]))
    return "Conflict" if revision == saved["revision"] and not same else None


def upsert_outcomes(incoming: DataFrame, manifests: DataFrame, head: int) -> DataFrame:
    """``incoming`` (``artifact_id``, ``payload``) with ``length``, ``digest``, ``revision`` and ``outcome``: accepted, quiet or fenced.

    An id that comes several times counts with its first digest; accepted versions are numbered from the head on, in the order of a hash of their ids.
    """
    payload = F.col("payload").cast("binary")
    sized = incoming.select("artifact_id", payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("length"), F.sha2(payload, 256).alias("digest"))
    first = sized.groupBy("artifact_id").agg(F.min_by(F.struct("payload", "length", "digest"), "digest").alias("v")).select("artifact_id", "v.*")
    saved = manifests.select("artifact_id", F.col("deleted").alias("__dead"), F.col("length").alias("__length"), F.col("digest").alias("__digest"))
    joined = first.join(saved, "artifact_id", "left")
    same = (F.col("__length") == F.col("length")) & (F.col("__digest") == F.col("digest"))
    told = joined.withColumn("outcome", F.when(F.col("__dead"), "fenced").when(same, "quiet").otherwise("accepted")).drop("__dead", "__length", "__digest")
    # 4,096 ranges of the hash count their own; one row for each carries what is before it.
    narrow = told.filter("outcome = 'accepted'").select("artifact_id")
    bucket = F.substring(F.sha2(F.col("artifact_id").cast("string"), 256), 1, 3)
    counted = narrow.withColumn("__b", bucket)
    sizes = counted.groupBy("__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counted.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("artifact_id"))).join(sizes.select("__b", before.alias("__o")), "__b")
    return told.join(ranked.select("artifact_id", (F.col("__r") + F.col("__o") + head).cast("bigint").alias("revision")), "artifact_id", "left")


def assemble(rows: DataFrame, buckets: int | None = None) -> DataFrame:
    """``artifact_id``, ``length``, ``chunks``, ``contiguous``, ``digest`` of chunk rows, hashed as a stream.

    Chunks are sorted by (artifact, offset) inside hash partitions and hashed one after the other, so
    no artifact is ever held whole.
    """
    placed = rows.select("artifact_id", "offset", "bytes")
    placed = placed.repartition(buckets, "artifact_id") if buckets else placed.repartition("artifact_id")
    kind = rows.schema["artifact_id"].dataType.simpleString()

    def run(batches):
        key, digest, length, count, whole = None, None, 0, 0, True
        out: list[tuple] = []

        def flush():
            table = pa.table({n: [r[i] for r in out] for i, n in enumerate(("artifact_id", "length", "chunks", "contiguous", "digest"))}) if out else None
            out.clear()
            return table.to_batches() if table else []

        for batch in batches:
            for k, offset, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if digest is None or k != key:
                    if digest is not None:
                        out.append((key, length, count, whole, digest.hexdigest()))
                    key, digest, length, count, whole = k, hashlib.sha256(), 0, 0, True
                whole = whole and offset == length
                digest.update(data)
                length += len(data)
                count += 1
            yield from flush()
        if digest is not None:
            out.append((key, length, count, whole, digest.hexdigest()))
            yield from flush()

    return placed.sortWithinPartitions("artifact_id", "offset").mapInArrow(
        run, f"artifact_id {kind}, length bigint, chunks bigint, contiguous boolean, digest string"
    )


def verify(manifests: DataFrame, assembled: DataFrame) -> DataFrame:
    """Whether what was assembled is what the manifest names; artifacts of length 0 have no chunk and verify."""
    a = assembled.select("artifact_id", F.col("length").alias("got_length"), F.col("digest").alias("got_digest"), "contiguous")
    empty = hashlib.sha256(b"").hexdigest()
    got = F.coalesce("got_digest", F.lit(empty))
    verified = F.coalesce("contiguous", F.lit(True)) & (F.coalesce("got_length", F.lit(0)) == F.col("length")) & (got == F.col("digest"))
    return manifests.join(a, "artifact_id", "left").withColumn("verified", verified).drop("got_length", "got_digest", "contiguous")


def availability(deleted: Column, local_digest: Column, digest: Column, reachable: Column) -> Column:
    """What can be said of an artifact's bytes; a mismatch is never a hit, even offline."""
    return (
        F.when(deleted, "Deleted")
        .when(local_digest.isNotNull(), F.when(local_digest == digest, "CachedVerified").otherwise("HashMismatch"))
        .when(reachable, "MetadataOnly")
        .otherwise("SourceUnavailable")
    )


def without_revoked(cache: DataFrame, revoked: DataFrame, keys: list[str]) -> DataFrame:
    """Cache rows whose scope has not been revoked."""
    return cache.join(revoked.select(*keys).distinct(), keys, "left_anti")
