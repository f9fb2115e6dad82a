"""Approximate nearest neighbours by shifted Hilbert curves.

Each of several curves rotates all directions at random, keeps a few coordinates, shifts those,
and gives each vector its place on a Hilbert curve over the
grid. Spark range-partitions all vectors by (curve, key), so every vector gets a
rank on every curve; blocks of consecutive ranks are the windows. A query visits
the blocks around its rank. There one matrix product in single precision finds every candidate that could
be among the best, given a bound of its rounding error, and the cosines of those are taken in double precision.

The half-width of the windows is fitted: a bounded sample of queries is compared
with every row, and the half-width is the one at which ``FIT_RECALL`` of their
true neighbours lie in the window of at least one curve. It is thus as small as the data
allow and may be as large as all of them; nothing is dropped at any width.

Vectors are first scaled by a power of two, which is exact, so that squares neither overflow nor vanish.
Vectors that are then equal count as one on the curves and carry their smallest ids, so a vector
that fills much of the table fills no window.

Nulls and edges: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows with a null id; vectors are compared with those of the same
length only; ties go to smaller ids; ids are whole numbers and should be unique, a repeated id is found once; an empty table
gives an empty result; other columns, whatever their names, do not interfere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.runtime import materialize

CURVES = 8
AXES, BITS = 20, 3
#: Ranks of a block, at least and at most; between these a window has about eight blocks.
BLOCKS = (512, 8192)
FIT_QUERIES = 200
FIT_RECALL = 0.94
#: Queries that meet one block in one task; more are dealt to copies of the block.
QUERIES_AT_ONCE = 1024


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid points (n, axes) on the Hilbert curve: Skilling's transposed form, Gray-coded plane by plane."""
    x = grid.T.astype(np.uint64).copy()
    axes, top = len(x), 1 << bits - 1
    q = top
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(axes):
            set_ = (x[i] & np.uint64(q)) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << np.uint64(1) | (x[i] >> np.uint64(plane)) & np.uint64(1)
    return key.astype(np.int64)


def curve_keys(unit: np.ndarray, curve: int) -> np.ndarray:
    """Keys of unit vectors on one curve; rotation and shift depend on the curve's number and the length only."""
    dim = unit.shape[1]
    rng = np.random.default_rng((curve, dim))
    axes = min(AXES, dim)
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :axes]
    reach = 1.5 / np.sqrt(dim)
    place = np.clip(unit @ turn / reach, -1, 1) / 4 + 0.25 + rng.random(axes) / 2
    return hilbert_keys((place * ((1 << BITS) - 1)).astype(np.int64), BITS)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` (or of one vector) with those of ``b``, in double precision."""
    norm = np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1))
    return (a * b).sum(axis=-1) / norm


def _scaled(batches):
    """Each vector times the power of two that brings its largest component to 0.5 or more and below 1."""
    for batch in batches:
        column = batch.column(1)
        values = column.flatten().to_numpy(zero_copy_only=False)
        if len(values):
            sizes = pa.compute.list_value_length(column).to_numpy()
            starts = np.cumsum(sizes) - sizes
            exponent = np.frexp(np.maximum.reduceat(np.abs(values), starts))[1]
            values = np.ldexp(values, -np.repeat(exponent, sizes))
            column = pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, column.type.value_type))
        yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["id", "v"])


def _clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and the scaled ``v`` (floats stay floats, all else becomes doubles) of the rows that take part."""
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    v: Column = F.col(f"`{vector}`").cast(kind)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(f"`{key}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(f"`{key}`").cast("bigint").alias("id"), v.alias("v")).mapInArrow(_scaled, f"id bigint, v {kind}")


def _by_length(table: pa.Table, name: str):
    lengths = pa.compute.list_value_length(table[name]).to_numpy()
    for n in np.unique(lengths):
        yield int(n), table.filter(pa.array(lengths == n))


def _keyed(batches):
    for batch in batches:
        for _, part in _by_length(pa.Table.from_batches([batch]), "v"):
            unit = _unit(_matrix(part["v"]))
            for c in range(CURVES):
                yield from part.append_column("curve", pa.array(np.full(len(unit), c, np.int32))).append_column(
                    "key", pa.array(curve_keys(unit, c))
                ).select(["curve", "key", "id", "ids", "v"]).combine_chunks().to_batches()


def _numbered(batches):
    at: dict[int, int] = {}
    for batch in batches:
        curve = batch.column(0).to_numpy()
        place = np.empty(len(curve), np.int64)
        for c in np.unique(curve):
            mine = np.flatnonzero(curve == c)
            place[mine] = at.get(int(c), 0) + np.arange(len(mine))
            at[int(c)] = at.get(int(c), 0) + len(mine)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=["curve", "key", "id", "ids", "v", "place"])


def ranked(groups: DataFrame) -> DataFrame:
    """``curve``, ``rank``, ``id``, ``ids``, ``v``: every vector's rank on every curve."""
    kinds = f"curve int, key bigint, id bigint, ids array<bigint>, v {groups.schema['v'].dataType.simpleString()}"
    placed = groups.select("id", "ids", "v").mapInArrow(_keyed, kinds)
    parts = max(CURVES, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = placed.repartitionByRange(parts, "curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    placed = placed.mapInArrow(_numbered, kinds + ", place bigint").withColumn("part", F.spark_partition_id())
    placed = materialize(placed, "curves")
    sizes = placed.groupBy("curve", "part").agg(F.count("*").alias("n")).orderBy("curve", "part").collect()
    offsets, before = [], {}
    for r in sizes:  # a row for each curve and partition
        offsets.append((r["curve"], r["part"], before.get(r["curve"], 0)))
        before[r["curve"]] = before.get(r["curve"], 0) + r["n"]
    table = groups.sparkSession.createDataFrame(offsets, "curve int, part int, offset bigint")
    joined = placed.join(F.broadcast(table), ["curve", "part"])
    return joined.select("curve", (F.col("offset") + F.col("place")).alias("rank"), "id", "ids", "v")


def _best_in_block(top: int, others_only: bool = False):
    """``qid``, ``id``, ``score`` of the best of a block for each query; ``others_only`` leaves out a query's own group."""

    def run(queries: pa.Table, block: pa.Table):
        parts = []
        for n, part in _by_length(block, "v"):
            asked = queries.filter(pa.compute.equal(pa.compute.list_value_length(queries["q"]), n))
            if not len(asked):
                continue
            q, v = _matrix(asked["q"]), _matrix(part["v"])
            qid, lead = asked["qid"].to_numpy(), part["id"].to_numpy()
            near = _unit(q).astype(np.float32) @ _unit(v).astype(np.float32).T
            if others_only:
                near[qid[:, None] == lead[None, :]] = -np.inf
            if near.shape[1] > top:
                # Rounding moves a product of unit vectors by less than the margin's half; whatever may be among the best stays.
                margin = np.float32(2 * (n + 8) * 2.0**-23)
                row, col = np.nonzero(near >= np.partition(near, -top, axis=1)[:, [-top]] - margin)
            else:
                row, col = np.nonzero(near > -np.inf)
            held = part["ids"].combine_chunks()
            sizes = pa.compute.list_value_length(held).to_numpy()
            starts, flat = np.cumsum(sizes) - sizes, held.flatten().to_numpy()
            for a in range(0, len(row), 1 << 16):
                r, c = row[a : a + (1 << 16)], col[a : a + (1 << 16)]
                score = cosines(q[r], v[c])
                of = np.repeat(np.arange(len(r)), sizes[c])
                at = np.arange(len(of)) - np.repeat(np.cumsum(sizes[c]) - sizes[c], sizes[c]) + starts[c][of]
                found = pa.table({"qid": qid[r][of], "id": flat[at], "score": score[of]})
                parts.append(_top(found, top))
        empty = pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _top(pa.concat_tables([empty, *parts]), top)

    return run


def _top(found: pa.Table, top: int) -> pa.Table:
    """The first ``top`` of each query, best first, ties to smaller ids; an id counts once."""
    q, i, s = (found[c].to_numpy() for c in ("qid", "id", "score"))
    order = np.lexsort((-s, i, q))
    order = order[np.concatenate([[True], (np.diff(q[order]) != 0) | (np.diff(i[order]) != 0)])[: len(order)]]
    q, i, s = q[order], i[order], s[order]
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    ok = rank < top
    return pa.table({"qid": q[ok], "id": i[ok], "score": s[ok]})


def _fit_width(ranks: DataFrame, queries: DataFrame, top: int) -> int:
    """The half-width from a bounded sample of queries (the first by a hash), each compared with every other group."""
    sample = queries.select("qid", "q").orderBy(F.xxhash64("qid"), "qid").limit(FIT_QUERIES).toArrow()
    if not len(sample):
        return BLOCKS[0]
    held = ranks.sparkSession.sparkContext.broadcast(sample)  # FIT_QUERIES vectors

    def scan(batches):
        for batch in batches:
            best = _best_in_block(top, others_only=True)(held.value, pa.Table.from_batches([batch]))
            yield from best.combine_chunks().to_batches()

    # Of a group of equal vectors one id is enough: its copies have its place.
    lead = F.array("id").alias("ids")
    per_task = ranks.filter("curve = 0").select("id", lead, "v").mapInArrow(scan, "qid bigint, id bigint, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    true = per_task.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).select("qid", "id")
    places = ranks.select("curve", "rank", "id")
    home = ranks.select("curve", F.col("rank").alias("home"), F.col("id").alias("qid"))
    least = (
        true.join(places, "id").join(home, ["qid", "curve"])
        .groupBy("qid", "id").agg(F.min(F.abs(F.col("rank") - F.col("home"))).alias("d"))
    )
    gaps = np.sort(least.select("d").toArrow()["d"].to_numpy())  # FIT_QUERIES * top numbers
    return int(gaps[min(len(gaps) - 1, int(np.ceil(FIT_RECALL * len(gaps))))]) + 1 if len(gaps) else BLOCKS[0]


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest other rows found for each row that ``is_query`` marks.

    ``is_query`` is a condition on the column ``id``.
    """
    rows = materialize(_clean(vectors, key, vector), "vectors")
    # One more than k for the query itself; row_number below a limit is cut before the shuffle.
    first = Window.partitionBy("v").orderBy("id")
    small = rows.dropDuplicates(["id", "v"]).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    groups = small.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))
    groups = materialize(groups, "groups")
    asking = rows.filter(is_query).select("id", "v").distinct()
    askers = materialize(asking.join(groups.select("v", F.col("id").alias("qid")), "v").select("id", "qid"), "askers")
    ranks = ranked(groups)
    lead = groups.join(askers.select(F.col("qid").alias("id")).distinct(), "id", "left_semi")
    queries = lead.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    width = _fit_width(ranks, queries, k)
    block_size = min(max(width // 4, BLOCKS[0]), BLOCKS[1])

    places = ranks.select("curve", "rank", F.col("id").alias("qid")).join(queries, "qid")
    last = F.floor((F.col("rank") + width) / block_size)
    visits = places.select("curve", "qid", "q", F.explode(F.sequence(F.floor(F.greatest(F.col("rank") - width, F.lit(0)) / block_size), last)).alias("block"))
    # A window meets 2 * width / block_size + 1 blocks, a block as many queries as lie that near.
    crowd = visits.groupBy("curve", "block").agg(F.count("*").alias("n"))
    shares = crowd.select("curve", "block", F.ceil(F.col("n") / QUERIES_AT_ONCE).cast("int").alias("shares"))
    dealt = visits.join(shares, ["curve", "block"]).withColumn("share", F.pmod(F.xxhash64("qid"), F.col("shares")).cast("int"))
    blocks = ranks.withColumn("block", F.floor(F.col("rank") / block_size)).join(shares, ["curve", "block"])
    blocks = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    keys = ["curve", "block", "share"]
    theirs = [F.col(c).alias(f"of_{c}") for c in keys]
    best = _best_in_block(k + 1)
    pairs = (
        dealt.select(*keys, "qid", "q").groupBy(*keys)
        .cogroup(blocks.select(*theirs, "id", "ids", "v").groupBy(*[f"of_{c}" for c in keys]))
        .applyInArrow(lambda q, b: best(q, b), "qid bigint, id bigint, score double")
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "near")
    merged = pairs.groupBy("qid", F.col("id").alias("near")).agg(F.max("score").alias("score"))
    merged = merged.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).drop("r")
    out = askers.join(merged, "qid").filter("id <> near")
    own = Window.partitionBy("id").orderBy(F.desc("score"), "near")
    out = out.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return out.select(F.col("id").alias("query_id"), "rank", F.col("near").alias("vec_id"), "score")
