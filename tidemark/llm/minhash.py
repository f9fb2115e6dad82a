"""Near-duplicate detection: one-permutation hashing with optimal densification.

Every text becomes its set of distinct five-word shingles. Identical sets are
collapsed first. Each remaining set fills the bins of one permutation, empty
bins borrow from full ones by a fixed random probing order, and bands of bins form
bucket keys. In each bucket the smallest document is the centre of a star:
only pairs (centre, member) become candidates, so their count is bounded by the
bucket rows. Candidates are confirmed on the full sets of the two texts.

A star alone could miss a link between two members that are not linked with the
centre. Members of buckets that end up in different components therefore go
through an exact second search: linked sets of n shingles must share one of their first
n - ceil(p n) + 1 shingles, at the least similarity p, in any common order, so these prefixes, rarest shingles
first, are buckets again. Large families of texts that are alike but not linked fall apart
there, since what each has of its own is rare. In these buckets, in rounds, members are pivots, each compared
with the bucket's remaining members of other components and then retired, until no bucket with
two components is left. No bucket is capped, none is expanded into all its pairs.

Nulls and edges: null and empty texts, and texts without a word, have an empty
set and link with nothing; texts of fewer than five words have the whole sequence as
their only shingle; texts with null ids link with nothing; rows that share an id are one node; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm.graph import components, join_dealt
from tidemark.llm.runtime import materialize
from tidemark.llm.textbatch import chunked, mix, slices, windows, word_hashes_of

SHINGLE = 5
#: Links need 100 * intersection >= percent * union: a similarity of 0.8 or more, unless a caller gives its own.
PERCENT = 80
#: A linked pair at the threshold shares no bucket with at most this probability, if its bins agree independently.
MISSED = 1e-8
#: Pivots of one bucket in one exact round, at most; the rounds go on until none is left.
PIVOTS = 1024
#: Slots of the hashed counts by which prefixes are ordered; any order is exact, a rarer-first one is fast.
SLOTS = 1 << 20

_BINS = 240
_PROBES = np.random.Generator(np.random.PCG64(11)).integers(0, _BINS, (1 << 12, _BINS))
_BAND_SALT = mix(np.arange(1, _BINS + 1, dtype=np.uint64))


def layout(percent: int) -> tuple[int, int]:
    """Bands and rows of each: the most rows that miss at most ``MISSED`` of the pairs at the threshold."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent is {percent}, not 1 to 100")
    for rows in (6, 5, 4, 3, 2):
        if (1 - (percent / 100) ** rows) ** (_BINS // rows) <= MISSED:
            return _BINS // rows, rows
    return _BINS, 1


def least_size(percent: int) -> int:
    """Smaller sets can only link with identical ones: of n and n + 1 shingles they share n at most."""
    return max(1, -(-percent // (100 - percent))) if percent < 100 else 1 << 62


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, lower-cased A-Z."""
    words, doc, n_words = word_hashes_of(column, lower=True)
    at, hashes = windows(words, doc, size)
    cut = np.searchsorted(doc[at], np.arange(len(n_words) + 1))
    first = np.concatenate([[0], np.cumsum(n_words)])
    out = []
    for i in range(len(n_words)):
        if cut[i + 1] > cut[i]:
            out.append(np.unique(hashes[cut[i] : cut[i + 1]]))
        elif n_words[i]:
            _, whole = windows(words[first[i] : first[i + 1]], doc[first[i] : first[i + 1]], int(n_words[i]))
            out.append(mix(whole + np.uint64(n_words[i])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation minima of each non-empty set, densified; one row of ``BANDS * ROWS`` bins each."""
    sig = np.zeros((len(sets), _BINS), np.uint64)
    full = np.zeros((len(sets), _BINS), bool)
    for i, s in enumerate(sets):
        bins = ((s >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        sig[i, bins[first]] = s[first]
        full[i, bins[first]] = True
    row, bin_ = np.nonzero(~full)
    for probe in _PROBES:
        if not len(row):
            return sig
        source = probe[bin_]
        hit = full[row, source]
        sig[row[hit], bin_[hit]] = mix(sig[row[hit], source[hit]] + np.uint64(1))
        row, bin_ = row[~hit], bin_[~hit]
    for r in np.unique(row):  # practically never: a set that no probe has met
        sig[r, bin_[row == r]] = mix(sets[r][0] + np.uint64(1))
    return sig


def _feature_batch(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    n_bands, n_rows = layout(percent)
    sets = shingle_sets(batch.column(1))
    size = np.array([len(s) for s in sets], np.int64)
    marks = np.zeros((2, len(sets)), np.uint64)
    for i, s in enumerate(sets):
        marks[0, i] = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        marks[1, i] = mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    big = np.flatnonzero(size >= least_size(percent))
    sig = signatures([sets[i] for i in big]).reshape(len(big), n_bands, n_rows)
    keys = np.tile(_BAND_SALT[:n_bands], (len(big), 1))
    for r in range(n_rows):
        keys = mix(keys ^ sig[:, :, r]) + np.uint64(r)
    counts = np.zeros(len(sets) + 1, np.int32)
    counts[1:][big] = n_bands
    bands = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
    columns = [batch.column(0), pa.array(size), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)), bands]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "mark1", "mark2", "bands"])


def _confirm(batches, percent: int):
    """Links among candidate pairs (a, b) with both texts, on the full sets."""
    for batch in batches:
        for piece in slices(batch, "text_b"):
            # One set for each text, not for each id: rows that share an id may have unlike texts.
            texts = piece.column("text_a").dictionary_encode(null_encoding="encode")
            which = texts.indices.to_numpy(zero_copy_only=False)
            left = shingle_sets(texts.dictionary)
            right = shingle_sets(piece.column("text_b"))
            ok = np.zeros(len(which), bool)
            for i, s in enumerate(right):
                c = left[which[i]]
                if min(len(c), len(s)) * 100 < percent * max(len(c), len(s)) or not len(s):
                    continue
                both = len(np.intersect1d(c, s, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(c) + len(s) - both)
            yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b"), pa.array(ok)], names=["a", "b", "linked"])


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _slot_counts(batches):
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for piece in slices(batch, "text"):
            for s in shingle_sets(piece.column("text")):
                np.add.at(total, _slot(s), 1)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])


def prefixes(texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``key``, ``place``, ``node``, ``n``: the shingles of each text's prefix with their places, in the order of hashed counts, then hashes."""
    rows = texts.select("doc_id", "text").mapInArrow(_slot_counts, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(SLOTS, np.int64)
    table = rows.toArrow()  # SLOTS rows at most
    counts[table["slot"].to_numpy()] = table["n"].to_numpy()
    held = texts.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1))
        keys = []
        for s in sets:
            keys.append(s[np.lexsort((s, held.value[_slot(s)]))[: prefix_size(len(s), percent)]])
        at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
        columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
        return pa.RecordBatch.from_arrays(columns, names=["node", "n", "keys"])

    found = texts.select("doc_id", "text").mapInArrow(chunked(run, "text"), "node bigint, n bigint, keys array<bigint>")
    return found.select(F.posexplode("keys").alias("place", "key"), "node", "n")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: whether any texts of the two ids meet the threshold.

    The centre of a star may be in very many pairs, so those of one id are dealt out, each part with its text.
    """
    pairs = materialize(pairs.select("a", "b"), "pairs")
    total = pairs.count()
    with_b = join_dealt(pairs, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b", "a", total, pairs)
    with_a = join_dealt(with_b, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a", "b", total, pairs)
    return with_a.select("a", "b", "text_a", "text_b").mapInArrow(lambda batches: _confirm(batches, percent), "a bigint, b bigint, linked boolean")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the buckets whose members are not all in one component."""
    keys = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    return rows.join(keys.select("key"), "key", "left_semi")


def _in_components(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _work_off(rest: DataFrame, texts: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Components once every two rows of one bucket are linked, compared, in one component, or cannot be linked.

    ``rest`` has ``key``, ``place``, ``node``, ``n``. If the first shingle that two sets share has ``r`` and ``s`` shingles
    after it, they share at most 1 + min(r, s); pairs for which that is too few are not compared.
    """
    compared = None
    turn = 0
    while True:
        rest = materialize(_mixed(_in_components(rest, found)), "rest")
        if rest.isEmpty():
            return found
        slots = min(PIVOTS, 256 << turn)
        pivots = rest.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(slots)).alias("slot")).agg(
            F.min("node").alias("pivot"), F.min_by("n", "node").alias("pivot_n"),
            F.min_by("place", "node").alias("pivot_place"), F.min_by("component", "node").alias("pivot_c"),
        )
        near = rest.join(pivots, "key").filter(
            f"component <> pivot_c AND 100 * least(n, pivot_n) >= {percent} * greatest(n, pivot_n)"
            f" AND {100 + percent} * least(n - place, pivot_n - pivot_place) >= {percent} * (n + pivot_n)"
        )
        pairs = near.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        checked = materialize(confirm(pairs, texts, percent), "links")
        compared = checked.select("a", "b") if compared is None else compared.unionByName(checked.select("a", "b"))
        fresh = checked.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        if not fresh.isEmpty():
            found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(fresh))
        done = pivots.select("key", F.col("pivot").alias("node"))
        rest = rest.join(done, ["key", "node"], "left_anti").select("key", "place", "node", "n")
        turn += 1


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for each row of ``docs``; texts link from ``percent`` on.

    Ids are whole numbers; other types are refused with a TypeError.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} is {docs.schema[key].dataType.simpleString()}, not a whole number")
    least = least_size(percent)
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = "doc_id bigint, n_shingles bigint, mark1 bigint, mark2 bigint, bands array<bigint>"
    feats = materialize(texts.mapInArrow(chunked(lambda batch: _feature_batch(batch, percent), "text"), schema), "shingles")

    # Identical sets become one node, their smallest id.
    marks = ["n_shingles", "mark1", "mark2"]
    full = feats.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(full.groupBy(*marks).agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    shared = join_dealt(full.select("doc_id", *marks), classes.filter("copies > 1").withColumnRenamed("copies", "n"), marks, "doc_id", total)
    same = shared.filter("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))

    nodes = classes.filter(f"n_shingles >= {least}").select(F.col("node").alias("doc_id"), *marks)
    lead = feats.filter(f"n_shingles >= {least}").join(nodes, ["doc_id", *marks], "left_semi")
    rows = lead.select(F.explode("bands").alias("key"), F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"))
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last")
    buckets = materialize(rows.join(hubs.select("key", "hub"), "key"), "buckets")

    # From here on only texts that share a bucket are read.
    meeting = buckets.select(F.col("node").alias("doc_id")).distinct()
    near_texts = materialize(texts.join(meeting, "doc_id", "left_semi"), "texts")
    stars = buckets.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = confirm(stars, near_texts, percent).filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = components(links)

    unsettled = _mixed(_in_components(buckets.filter("node <> hub").select("key", "node", "n"), found))
    unsettled = materialize(unsettled.select(F.col("node").alias("doc_id")).distinct(), "unsettled")
    if not unsettled.isEmpty():
        found = _work_off(prefixes(near_texts.join(unsettled, "doc_id", "left_semi"), percent), near_texts, found, percent)
    found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(same))

    groups = found.select(F.col("node").alias("doc_id"), "component")
    out = feats.select("doc_id", "n_shingles").join(groups, "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
