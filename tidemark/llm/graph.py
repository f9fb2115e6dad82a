"""Connected components by alternating large and small stars, on DataFrames only.

Each step is one minimum per node and one join back, in which the edges of a hub are dealt out, so a hub is never
collected nor in one task; the edge count never grows and the rounds grow with the logarithm of the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import materialize


#: A key with more than this share of all rows is dealt out; so there are at most as many such keys as its inverse.
HOT_SHARE = 1 / 1000
PARTS = 64


def join_dealt(rows: DataFrame, table: DataFrame, on: str | list[str], by: str, total: int, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (inner or left), where the rows of hot keys are dealt by a hash of ``by`` to ``PARTS`` copies of the key's row.

    ``total`` is the number of rows. How many rows a key has is told by the column ``n`` of ``table``, which is left out of the result, or is
    counted over ``counts``, which has a row for each. Hot keys are 1 / ``HOT_SHARE`` at most, so they may be broadcast.
    """
    keys = [on] if isinstance(on, str) else list(on)
    sizes = table if counts is None else counts.groupBy(*keys).agg(F.count("*").alias("n"))
    hot = F.broadcast(sizes.filter(F.col("n") > total * HOT_SHARE).select(*keys, F.lit(True).alias("__hot")))
    part = F.when(F.col("__hot"), F.pmod(F.xxhash64(F.col(by)), F.lit(PARTS)).cast("int")).otherwise(0).alias("__part")
    dealt = rows.join(hot, keys, "left").select(*rows.columns, part)
    if counts is None:
        columns, marked, is_hot = [c for c in table.columns if c != "n"], table, F.col("n") > total * HOT_SHARE
    else:
        columns, marked, is_hot = table.columns, table.join(hot, keys, "left"), F.col("__hot")
    copies = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))).alias("__part")
    return dealt.join(marked.select(*columns, copies), [*keys, "__part"], how).drop("__part")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    moved = join_dealt(both.filter("v > u"), least, "u", "v", 2 * total)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_dealt(edges, least, "u", "v", total)
    moved = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest reachable node) for every node that is not the smallest of its own.

    ``edges`` has long columns ``u`` and ``v``; loops, repeated edges and nulls are ignored.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        edges = materialize(_small_star(_large_star(edges, mark[0]), mark[0]), "edges")
