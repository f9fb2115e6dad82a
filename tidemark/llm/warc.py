"""Merkle fixity audit of WARC files.

Pages become WARC/1.0 resource records with a record id and a date, in files of a fixed number of pages, with running byte
offsets. A record is hashed where it is read; from then on only its place, length and digest travel. A leaf is the hash of a
record's place and content; leaves are hashed, in the order of their offsets, into nodes over ranges of offsets,
ranges into files, files into ever larger groups, up to one root. Two replicas are compared from the root
down: only the children of nodes that differ are read. At the bottom records are compared by id, so a record that was
cut short is told from those that only moved up behind it.

Equal records of one file are one leaf with a number of copies. A file with more than ``HOT_SHARE`` of all records is
dealt out to files of its own by a hash of the content, so no window sees more than that.

Nulls and edges: a null url or page counts as empty; rows with a null page id go to
files of their own; rows with equal ids are ordered by url, then content; repeated rows are copies, whose number is audited;
an empty table has no root and differs from any other; two empty replicas agree; columns of any other name do not interfere;
bytes that are no record when files are read raise ValueError.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.runtime import materialize

PAGES_PER_FILE = 256
#: Bytes of a file that one node covers.
RANGE_BYTES = 1 << 18
FANOUT = 64
DATE = "2020-01-01T00:00:00Z"
#: Files of fewer records are never dealt out; at most 1 / ``HOT_SHARE`` are.
LEAST_HOT, HOT_SHARE = 1024, 1 / 1000

_HEAD = re.compile(rb"WARC/1\.0\r\n((?:[^\r\n]+\r\n)*)\r\n")


def warc_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", per_file: int = PAGES_PER_FILE, date: str = DATE) -> DataFrame:
    """``file``, ``page_id``, ``url``, ``record_id``, ``payload``: the pages as WARC records, in their files, without a shuffle."""
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    target = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    id_ = F.col(f"`{key}`").cast("bigint")
    # Files without ids, and the parts of hot files, are numbered behind all others, so that the tree stays low.
    total, last = pages.agg(F.count("*"), F.coalesce(F.max(F.floor(id_ / per_file)), F.lit(0))).first()
    behind = max(int(last), 0) + 2
    base = F.coalesce(F.floor(id_ / per_file), F.lit(behind - 1)).cast("bigint")
    sizes = pages.groupBy(base.alias("__base")).agg(F.count("*").alias("__n")).filter(F.col("__n") > max(LEAST_HOT, int(total * HOT_SHARE)))
    parts = F.broadcast(sizes.select("__base", F.ceil(F.col("__n") / LEAST_HOT).alias("__parts")))  # 1 / HOT_SHARE rows at most
    digest = F.md5(F.concat_ws("\n", F.coalesce(id_.cast("string"), F.lit("")), target, body).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), F.col("__uuid"), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("__body").cast("string"), F.lit("\r\n\r\n"),
    )
    rows = pages.select(base.alias("__base"), id_.alias("page_id"), F.regexp_replace(target, r"[\r\n]", " ").alias("url"), body.alias("__body"), uuid.alias("__uuid"))
    rows = rows.join(parts, "__base", "left")
    part = F.when(F.col("__parts").isNotNull(), 1 + F.pmod(F.xxhash64("__uuid"), F.col("__parts"))).otherwise(0)
    payload = F.encode(F.concat(head, F.col("__body"), F.lit("\r\n\r\n")), "UTF-8")
    return rows.select((F.col("__base") + part * behind).cast("bigint").alias("file"), "page_id", "url", F.col("__uuid").alias("record_id"), payload.alias("payload"))


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The header fields and the block of the record that begins at a place, and where the next one begins."""
    head = _HEAD.match(raw, at)
    if not head:
        raise ValueError(f"no record at {at}")
    fields = {}
    for line in head.group(1).decode().splitlines():
        name, _, value = line.partition(":")
        fields[name.strip()] = value.strip()
    end = head.end() + int(fields["Content-Length"])
    if raw[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} does not end at {end}")
    return fields, raw[head.end() : end], end + 4


def read_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The records in WARC files (as Spark's binaryFile source gives them): ``path``, ``offset``, ``length``, ``record_id``, ``url``, ``date``, ``html``."""
    names = ["path", "offset", "length", "record_id", "url", "date", "html"]

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw, at, out = raw.as_py() or b"", 0, []
                while at < len(raw):
                    fields, block, after = parse(raw, at)
                    out.append((name, at, after - at, fields["WARC-Record-ID"].removeprefix("<urn:uuid:").removesuffix(">"), fields["WARC-Target-URI"], fields["WARC-Date"], block.decode()))
                    at = after
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    rows = files.select(F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{content}`").cast("binary").alias("content"))
    return rows.mapInArrow(run, "path string, offset bigint, length bigint, record_id string, url string, date string, html string")


def index(records: DataFrame) -> DataFrame:
    """``file``, ``offset``, ``length``, ``copies``, ``page_id``, ``record_id``, ``digest``: where the records of a replica lie in its files.

    ``records`` has ``file``, ``page_id``, ``url``, ``record_id`` and ``payload``; payloads are hashed before the shuffle.
    """
    payload = F.coalesce("payload", F.lit(b""))
    rows = records.select("file", "page_id", "url", "record_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("length"))
    runs = rows.groupBy("file", "page_id", "url", "record_id", "digest", "length").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("file").orderBy("page_id", "url", "record_id", "digest")
    before = F.sum(F.col("length") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return runs.select("file", F.coalesce(before, F.lit(0)).cast("bigint").alias("offset"), "length", "copies", "page_id", "record_id", "digest")


def leaves(records: DataFrame) -> DataFrame:
    """The index with ``range`` and the leaf's ``hash`` of place and content."""
    place = F.concat_ws(":", "offset", "length", "copies", "record_id", "digest")
    return index(records).withColumns({"range": F.floor(F.col("offset") / RANGE_BYTES), "hash": F.sha2(place, 256)})


def _roll(nodes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Hash the nodes below each key, in order, into one node."""
    ordered = F.sort_array(F.collect_list(F.struct(order, "hash")))
    return nodes.groupBy(*keys).agg(F.sha2(F.concat_ws("", F.transform(ordered, lambda x: F.concat_ws(":", x[order], x["hash"]))), 256).alias("hash"))


def tree(leaf: DataFrame, top_level: int) -> list[DataFrame]:
    """Levels of nodes: ranges (file, range), files (node), then groups of ``FANOUT`` nodes up to one root."""
    ranges = _roll(leaf, ["file", "range"], "offset")
    files = _roll(ranges, ["file"], "range").withColumnRenamed("file", "node")
    levels = [ranges, files]
    for _ in range(top_level):
        below = levels[-1].withColumn("up", F.floor(F.col("node") / FANOUT))
        levels.append(_roll(below, ["up"], "node").withColumnRenamed("up", "node"))
    return levels


def _differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    both = left.select(*keys, F.col("hash").alias("l")).join(right.select(*keys, F.col("hash").alias("r")), keys, "full")
    return both.filter(~F.col("l").eqNullSafe(F.col("r"))).select(*keys)


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """``file``, ``offset``, ``page_id``, ``length``, ``found_offset``, ``found_length`` and ``status`` of each damaged record.

    ``left`` is the replica that is held true. ``status`` is missing, extra or changed (another content, or another number of copies).
    """
    sides = [materialize(leaves(x), "leaves") for x in (left, right)]
    span = [x.agg(F.max(F.abs("file"))).first()[0] or 0 for x in sides]
    levels = 0
    while FANOUT**levels <= max(span):
        levels += 1
    trees = [[materialize(level, "nodes") for level in tree(x, levels)] for x in sides]
    # Each level's answer is written: it is read from both sides of the next.
    bad = materialize(_differing(trees[0][-1], trees[1][-1], ["node"]), "differing")
    for depth in range(levels, 0, -1):  # level 1 are the files, level 0 the ranges
        below = [t[depth].withColumn("up", F.floor(F.col("node") / FANOUT)).join(bad.withColumnRenamed("node", "up"), "up", "left_semi") for t in trees]
        bad = materialize(_differing(below[0], below[1], ["node"]), "differing")
    bad = bad.withColumnRenamed("node", "file")
    ranges = [t[0].join(bad, "file", "left_semi") for t in trees]
    bad = materialize(_differing(ranges[0], ranges[1], ["file", "range"]), "differing")
    l, r = (x.join(bad, ["file", "range"], "left_semi") for x in sides)
    # One id may lie in a file with several contents, if the replica holds it damaged and whole: they are matched in order.
    nth = F.row_number().over(Window.partitionBy("file", "record_id").orderBy("offset")).alias("nth")
    l = l.select("file", "record_id", nth, F.col("offset").alias("l_at"), F.col("page_id").alias("l_id"), F.col("length").alias("l_len"), F.col("copies").alias("l_n"), F.col("digest").alias("l"))
    r = r.select("file", "record_id", nth, F.col("offset").alias("r_at"), F.col("page_id").alias("r_id"), F.col("length").alias("r_len"), F.col("copies").alias("r_n"), F.col("digest").alias("r"))
    both = l.join(r, ["file", "record_id", "nth"], "full").filter(~(F.col("l").eqNullSafe(F.col("r")) & F.col("l_n").eqNullSafe(F.col("r_n"))))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").otherwise("changed")
    return both.select(
        "file", F.col("l_at").alias("offset"), F.coalesce("l_id", "r_id").alias("page_id"), F.col("l_len").alias("length"),
        F.col("r_at").alias("found_offset"), F.col("r_len").alias("found_length"), status.alias("status"),
    )
