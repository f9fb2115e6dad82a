"""Quality rules with host verdicts.

Each text gets rule counts from one vectorised Arrow pass. Rule failures are
then summed by host, the failure rates are shrunk towards a beta prior fitted
by moments over all hosts, and documents of hosts that are bad beyond doubt are
rejected together with the documents that fail a rule themselves.

Nulls and edges: a null text counts as empty (0 words, which fails the length
rule); a null host is no host, so such documents have only their own verdict;
repeated rows are counted and returned each; an empty table gives an empty
result; other columns, whatever their names, do not interfere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import materialize
from tidemark.llm.textbatch import SPACE, Texts, is_long, map_texts, mix, spans, text_buffer, windows, word_hashes_of

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
#: A host is rejected if its shrunken failure rate less Z standard deviations exceeds this.
HOST_LIMIT = 0.5
HOST_Z = 3.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_STRUCT = "struct<" + ",".join(f"{name}:bigint" for name in FEATURES) + ">"


def _repeated(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words of each text in windows that it holds more than once."""
    at, hashes = windows(words, doc, REPEAT_WINDOW)
    _, which, times = np.unique(_within(hashes, doc[at]), return_inverse=True, return_counts=True)
    again = at[times[which] > 1] if len(at) else at
    edge = np.zeros(len(words) + REPEAT_WINDOW + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + REPEAT_WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge)[: len(words)] > 0], minlength=n)


def _long_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The same counts of one very long text, whose arrays are made a span at a time."""
    raw = text_buffer(column)[0].tobytes()
    words, doc, n_words = word_hashes_of(column)
    out = {"n_words": n_words, "n_symbols": 0, "word_chars": 0, "n_dup_lines": 0}
    for a, b in spans(raw):
        data = np.frombuffer(raw[a:b], np.uint8)
        out["n_symbols"] += int(_SYMBOL[data].sum())
        out["word_chars"] += int((~SPACE[data] & ((data & 0xC0) != 0x80)).sum())
    seen: set[bytes] = set()
    at = 0
    while at <= len(raw):
        end = raw.find(b"\n", at)
        end = len(raw) if end < 0 else end
        line = raw[at:end]
        if line.strip(b" \t\n\x0b\x0c\r"):
            digest = hashlib.blake2b(line, digest_size=16).digest()
            out["n_dup_lines"] += digest in seen
            seen.add(digest)
        at = end + 1
    return {k: np.array(v).reshape(1) for k, v in out.items()} | {"n_repeat_words": _repeated(words, doc, 1)}


def rule_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts named in ``FEATURES`` for each text of an Arrow column."""
    if is_long(column):
        return _long_counts(column)
    t = Texts(column)
    out = {"n_words": t.n_words, "n_symbols": t.per_text(_SYMBOL[t.data])}
    out["word_chars"] = t.per_text(~t.space & ((t.data & 0xC0) != 0x80))

    # Lines run from a text's start or a line feed to the next line feed or the text's end.
    breaks = np.flatnonzero(t.data == 10)
    starts = np.concatenate([t.off[:-1], breaks + 1])
    ends = np.concatenate([breaks, t.off[1:]])
    starts.sort()
    ends.sort()
    ink = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(~t.space, out=ink[1:])
    worded = ink[ends] > ink[starts]
    starts, ends = starts[worded], ends[worded]
    owner = t.owner(starts)
    _, first = np.unique(_within(t.hashes(starts, ends), owner), return_index=True)
    out["n_dup_lines"] = np.bincount(owner, minlength=t.n) - np.bincount(owner[first], minlength=t.n)

    out["n_repeat_words"] = _repeated(t.word_hashes(), t.doc, t.n)
    return out


def _within(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one text."""
    return mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))


def _rules(column: pa.Array) -> dict[str, pa.Array]:
    found = rule_counts(column)
    return {"__rules": pa.StructArray.from_arrays([pa.array(found[k], pa.int64()) for k in FEATURES], names=list(FEATURES))}


def with_rules(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``__row`` (the columns in ``carry``, or all) and ``__rules`` (the counts) for each row."""
    return map_texts(docs, text, carry, _rules, f"__rules {_STRUCT}")


def base_failed(rules: str = "__rules") -> Column:
    n, r = F.col(f"{rules}.n_words"), F.col(f"{rules}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def host_verdicts(flags: DataFrame, limit: float = HOST_LIMIT, z: float = HOST_Z) -> DataFrame:
    """``host``, ``host_rate`` and ``host_rejected`` from rows (``host``, ``failed``).

    The prior is fitted from five sums over all hosts; only those reach the driver. The host counts are kept, so
    that the texts are not read again for the verdicts.
    """
    counts = F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f")
    hosts = materialize(flags.filter("host IS NOT NULL").groupBy("host").agg(*counts), "hosts")
    s = hosts.agg(
        F.count("*").alias("h"),
        F.sum("n").alias("n"),
        F.sum("f").alias("f"),
        F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    ).first()
    alpha, beta = beta_prior(s["h"], s["n"] or 0, s["f"] or 0, s["ff"] or 0.0, s["nn"] or 0.0)
    total = F.col("n") + alpha + beta
    rate = (F.col("f") + alpha) / total
    spread = F.sqrt(rate * (1 - rate) / (total + 1))
    return hosts.select("host", rate.alias("host_rate"), (rate - z * spread > limit).alias("host_rejected"))


def beta_prior(hosts: int, rows: float, failed: float, failed_sq: float, rows_sq: float) -> tuple[float, float]:
    """Moment fit of a beta prior from sums over hosts of 1, n, f, f*f/n and n*n."""
    if not rows:
        return 1.0, 1.0
    mean = (failed + 0.5) / (rows + 1.0)
    spread = max(0.0, failed_sq - failed * failed / rows)
    noise = mean * (1 - mean)
    freedom = rows - rows_sq / rows - (hosts - 1)
    rho = (spread - noise * (hosts - 1)) / (noise * freedom) if freedom > 0 else 0.5
    rho = min(0.99, max(1e-4, rho))
    strength = 1 / rho - 1
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, text: str = "text", host: str = "source", carry: list[str] | None = None) -> DataFrame:
    """``__row``, ``__rules``, ``base_failed``, ``host_rate`` and ``kept`` for each document.

    The counts are computed twice, once for the host sums and once for the
    result: reading the texts again costs less than writing them out.
    """
    both = with_rules(docs, text, carry=[host])
    flags = both.select(F.col(f"__row.`{host}`").alias("host"), base_failed().alias("failed"))
    verdicts = host_verdicts(flags)
    rows = with_rules(docs, text, carry=list(dict.fromkeys([*(carry or docs.columns), host])))
    rows = rows.withColumns({"__host": F.col(f"__row.`{host}`"), "base_failed": base_failed()})
    joined = rows.join(verdicts, rows["__host"] == verdicts["host"], "left").drop("host", "__host")
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected)
