"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). The cells' weights are
raked: each dimension in turn is scaled to its target marginals, where a weight
is a keeping probability and stops at 1; the scale of a group is solved exactly with
that bound, so the others in it make up for cells that are used up. Documents are then
drawn, each by the probability of its cell and a hash of its id.

Cells are dimension combinations, not documents. Up to ``DRIVER_CELLS`` of them
are raked in numpy on the driver; beyond that the same steps run on DataFrames.

Nulls and edges: null sources, languages and topics are groups of their own; a null or
empty text has 0 tokens and takes its cell's probability; a null id is hashed as
such; rows with equal ids share their draw; marginals that cannot be met are met as far as their
tokens go; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.runtime import materialize

DRIVER_CELLS = 200_000
ROUNDS = 50
TOLERANCE = 1e-9
DIMENSIONS = ("source", "lang", "topic")
#: Markers of a text's topic, tried in this order.
TOPICS = (
    ("table", r" \| "),
    ("legal", r"(?i)licen[cs]e|rights reserved"),
    ("record", r"[0-9]{4}"),
    ("dialogue", r"[?!]"),
)


def topic(text: Column) -> Column:
    """The first of ``TOPICS`` whose pattern a text holds, or prose."""
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Words of a text, the tokens by which sources are weighed."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def tempered(sums: dict, power: float) -> dict:
    """Target shares in proportion to a power of the available tokens."""
    raised = {k: float(v) ** power if v else 0.0 for k, v in sums.items()}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def group_scale(tokens: np.ndarray, weight: np.ndarray, target: float) -> float:
    """The factor f with sum(tokens * min(1, f * weight)) = target, or the one that uses all up."""
    full = tokens[weight > 0].sum()
    if target >= full:
        return np.inf
    order = np.argsort(-weight)
    t, w = tokens[order], weight[order]
    used = np.concatenate([[0.0], np.cumsum(t)])  # tokens of cells at 1
    rest = np.concatenate([np.cumsum((t * w)[::-1])[::-1], [0.0]])
    for k in range(len(t)):
        if rest[k] > 0:
            f = (target - used[k]) / rest[k]
            if f * w[k] <= 1:
                return max(f, 0.0)
    return np.inf


def rake(cells: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray], budget: float, rounds: int = ROUNDS) -> np.ndarray:
    """Keeping probabilities of cells; ``cells`` has a group number for each dimension, ``targets`` shares by group."""
    weight = np.full(len(tokens), min(1.0, budget / max(1.0, tokens.sum())))
    for _ in range(rounds):
        before = weight.copy()
        for d, shares in enumerate(targets):
            order = np.argsort(cells[:, d], kind="stable")
            cut = np.searchsorted(cells[order, d], np.arange(len(shares) + 1))
            for g, share in enumerate(shares):
                mine = order[cut[g] : cut[g + 1]]
                f = group_scale(tokens[mine], weight[mine], share * budget)
                weight[mine] = np.where(weight[mine] > 0, np.minimum(1.0, f * weight[mine]), 0.0) if np.isfinite(f) else (weight[mine] > 0) * 1.0
        if np.abs(weight - before).max(initial=0) < TOLERANCE:
            break
    return weight


def _scaled(cells: DataFrame, dimension: str, shares: DataFrame, budget: float) -> DataFrame:
    """One raking step: ``group_scale`` of every group by running sums over its cells, largest weights first."""
    rows = cells.join(shares, F.col(dimension).eqNullSafe(F.col(f"of_{dimension}"))).drop(f"of_{dimension}")
    order = Window.partitionBy(dimension).orderBy(F.desc("p"), *[c for c in DIMENSIONS if c != dimension])
    used = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("tokens") * F.col("p")).over(order.rowsBetween(0, Window.unboundedFollowing))
    factor = F.when(rest > 0, F.greatest((F.col("share") * budget - used) / rest, F.lit(0.0)))
    rows = rows.withColumn("f", factor)
    fits = F.when(F.col("f") * F.col("p") <= 1, F.col("f"))
    first = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    full = F.sum(F.when(F.col("p") > 0, F.col("tokens"))).over(Window.partitionBy(dimension)) <= F.col("share") * budget
    raised = F.when(full | first.isNull(), F.when(F.col("p") > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), first * F.col("p")))
    return rows.withColumn("p", raised).select(*cells.columns)


def _rake_frames(cells: DataFrame, margins: dict[str, DataFrame], budget: float, rounds: int) -> DataFrame:
    """The same raking on DataFrames."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    state = materialize(cells.withColumn("p", F.lit(min(1.0, budget / total))), "cells")
    for _ in range(rounds):
        before = state
        for d, shares in margins.items():
            state = materialize(_scaled(state, d, shares, budget), "cells")
        keys = [F.col(f"a.{d}").eqNullSafe(F.col(f"b.{d}")) for d in margins]
        moved = state.alias("a").join(before.alias("b"), keys).agg(F.max(F.abs(F.col("a.p") - F.col("b.p")))).first()[0] or 0.0
        if moved < TOLERANCE:
            break
    return state


def cell_probabilities(rows: DataFrame, keep_share: float, power: dict[str, float], targets: dict[str, dict] | None = None, driver_cells: int = DRIVER_CELLS, rounds: int = ROUNDS) -> DataFrame:
    """``source``, ``lang``, ``topic``, ``p`` from rows with these and ``tokens``."""
    dims = list(DIMENSIONS)
    cells = materialize(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    spark = rows.sparkSession
    if cells.count() > driver_cells:
        margins = {}
        for d in dims:
            sums = cells.groupBy(F.col(d).alias(f"of_{d}")).agg(F.sum("tokens").alias("t"))
            if targets and d in targets:
                given = spark.createDataFrame(list(targets[d].items()), f"k {cells.schema[d].dataType.simpleString()}, share double")
                margins[d] = sums.join(given, F.col(f"of_{d}").eqNullSafe(F.col("k")), "left").select(f"of_{d}", F.coalesce("share", F.lit(0.0)).alias("share"))
            else:
                raised = sums.withColumn("x", F.pow(F.col("t").cast("double"), power[d]))
                total = raised.agg(F.sum("x")).first()[0] or 1.0
                margins[d] = raised.select(f"of_{d}", (F.col("x") / total).alias("share"))
        budget = keep_share * (cells.agg(F.sum("tokens")).first()[0] or 0)
        return _rake_frames(cells, margins, budget, rounds).select(*dims, "p")
    held = sorted((tuple(r) for r in cells.select(*dims, "tokens").collect()), key=lambda r: tuple((v is not None, str(v)) for v in r[:3]))
    tokens = np.array([float(r[3]) for r in held])
    codes, shares = np.zeros((len(held), 3), np.int64), []
    for d, name in enumerate(dims):
        groups = {v: i for i, v in enumerate(dict.fromkeys(r[d] for r in held))}
        codes[:, d] = [groups[r[d]] for r in held]
        sums = np.bincount(codes[:, d], tokens, minlength=len(groups)) if len(held) else np.zeros(0)
        wanted = (targets or {}).get(name) or tempered(dict(zip(groups, sums)), power[name])
        shares.append(np.array([wanted.get(v, 0.0) for v in groups]))
    p = rake(codes, tokens, shares, keep_share * tokens.sum(), rounds)
    kinds = ", ".join(f"{d} {cells.schema[d].dataType.simpleString()}" for d in dims)
    return spark.createDataFrame([(*r[:3], float(x)) for r, x in zip(held, p)], f"{kinds}, p double")


def uniform(key: Column, seed: int) -> Column:
    """A number from 0 (included) to 1 (not included), fixed by the key and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) * F.lit(2.0**-53)


def mix(docs: DataFrame, keep_share: float = 0.7, power: float = 0.7, targets: dict[str, dict] | None = None, seed: int = 1, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", carry: list[str] | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """``__row`` (the columns in ``carry``, or all), the cell, ``tokens``, ``probability`` and ``selected``.

    ``targets`` gives shares by dimension (source, lang, topic); dimensions
    without any are tempered: shares in proportion to the tokens to the given power.
    ``keep_share`` of all tokens are to be kept.
    """
    t = F.col(f"`{text}`").cast("string")
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("__row"),
        F.col(f"`{key}`").alias("__key"), F.col(f"`{source}`").alias("source"), F.col(f"`{lang}`").alias("lang"),
        topic(F.coalesce(t, F.lit(""))).alias("topic"), token_count(t).alias("tokens"),
    )
    cells = cell_probabilities(base.drop("__row", "__key"), keep_share, dict.fromkeys(DIMENSIONS, power), targets, driver_cells)
    cells = cells.select(*[F.col(d).alias(f"c_{d}") for d in DIMENSIONS], "p")
    if cells.limit(driver_cells + 1).count() <= driver_cells:
        cells = F.broadcast(cells)
    on = [F.col(d).eqNullSafe(F.col(f"c_{d}")) for d in DIMENSIONS]
    joined = base.join(cells, on, "left").withColumn("probability", F.coalesce("p", F.lit(0.0)))
    joined = joined.withColumn("selected", uniform(F.col("__key"), seed) < F.col("probability"))
    return joined.select("__row", "source", "lang", "topic", "tokens", "probability", "selected")

