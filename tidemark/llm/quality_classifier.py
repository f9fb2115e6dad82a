"""Quality classifier: supervised subword embeddings.

Words, word pairs and character n-grams are hashed into buckets and each bucket
has a learned vector. Word pairs are hashed by their pattern (the same word
again, or another) into two buckets of their own, since pairs of rare words would not generalise. A document
is the average of the vectors of all its features, and
a softmax over two classes gives the score. Training is plain numpy gradient descent on a bounded,
class-balanced sample of labelled rows. The output layer is linear in the average, so
scoring folds it into the embeddings once: every bucket then carries one
number, and a document's logit is the same average of its buckets' numbers.

Nulls and edges: a null text counts as empty; an empty text has no features and
gets the score of the bias alone; rows with a null label, or a label for no
document, teach nothing; an id with several labels has the smallest, one with several texts the
first in order; without both classes in the sample every score is the
share of label 1 (0.5 without labels); repeated rows are scored each; a very long text is worked on in spans, with the same
result; an empty table gives an empty result; other columns, whatever their names, do not interfere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.textbatch import Texts, chunked, is_long, map_texts, spans, text_buffer, word_hashes_of

BUCKETS = 1 << 16
DIM = 12
CHAR_ORDERS = (1, 2, 3)
#: Labelled rows of each class, and bytes of their texts, that training may use; documented bounds on what reaches the driver.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 1200, 8 << 20
THRESHOLD = 0.3
#: Hashed buckets, then the two patterns of word pairs.
ALL_BUCKETS = BUCKETS + 2
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


@dataclass(frozen=True)
class Model:
    """Per-bucket logits (embedding times the output layer's difference) and the bias."""

    bucket_logit: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        logit, count = np.zeros(len(column)), np.zeros(len(column), np.int64)
        for owner, bucket in features(column):
            count += np.bincount(owner, minlength=len(column))
            logit += np.bincount(owner, self.bucket_logit[bucket], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(logit / np.maximum(count, 1) + self.bias, -30, 30)))


def _characters(t: Texts, continues: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of n-grams; one may begin or end with white space, which marks a word's edge, but those of three hold none inside.

    A text that ``continues`` one begins with the last character of what was before, which has been counted.
    """
    heads = np.flatnonzero((t.data & 0xC0) != 0x80)
    owner = t.owner(heads)
    stops = np.append(heads, len(t.data))
    blank = np.zeros(len(heads) + 1, np.int64)
    np.cumsum(t.space[heads], out=blank[1:])
    for k in CHAR_ORDERS:
        n = len(heads) - k + 1
        if n <= 0:
            continue
        ok = owner[:n] == owner[k - 1 :]
        if k > 2:
            ok &= blank[k - 1 : k - 1 + n] == blank[1 : 1 + n]
        if k == 1 and continues:
            ok[0] = False
        at = np.flatnonzero(ok)
        yield owner[at], (t.hashes(heads[at], stops[at + k]) >> _SHIFT).astype(np.int64)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) arrays of all features of a slice of texts."""
    words, doc, _ = word_hashes_of(column)
    yield doc, (words >> _SHIFT).astype(np.int64)
    paired = np.flatnonzero(doc[1:] == doc[:-1])
    yield doc[paired], BUCKETS + (words[paired] == words[paired + 1]).astype(np.int64)
    if not is_long(column):
        yield from _characters(Texts(column), False)
        return
    raw = text_buffer(column)[0].tobytes()
    for a, b in spans(raw):
        yield from _characters(Texts(pa.array([raw[a : b + 1]], pa.binary())), a > 0)


def _bag_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Distinct buckets and their shares of each text, packed."""
    n = batch.num_rows
    found = [owner * ALL_BUCKETS + bucket for owner, bucket in features(batch.column(2))]
    keys, times = np.unique(np.concatenate(found), return_counts=True)
    cut = np.searchsorted(keys, np.arange(n + 1) * ALL_BUCKETS)
    size = np.add.reduceat(np.append(times, 0), cut[:-1]) * (np.diff(cut) > 0) if n else times
    share = (times / np.repeat(size, np.diff(cut))).astype(np.float32)
    keys = (keys % ALL_BUCKETS).astype(np.uint32)
    bags = [keys[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
    shares = [share[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(bags, pa.binary()), pa.array(shares, pa.binary())],
        names=["k", "label", "bag", "share"],
    )


def train_bags(bags: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 4.0, seed: int = 7) -> Model:
    """Gradient descent over documents in random order; vectors and output layer learn together."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((ALL_BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    n = len(labels)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(n):
            bag, share = bags[i], shares[i]
            mean = share @ vectors[bag]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= step * 0.1 * np.outer(mean, p)
            bias -= step * 0.01 * p
            vectors[bag] -= (step * share)[:, None] * back
    diff = out[:, 1] - out[:, 0]
    return Model((vectors @ diff).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from rows whose crc32 of the key's text modulo 5 is not 0.

    The sample takes for each class the ``per_class`` keys that come first in
    the order of a hash, as far as their texts fit ``SAMPLE_BYTES``, so it does not depend on partitioning.
    """
    k = F.col(f"`{key}`")
    usable = labels.select(k.alias("k"), F.col(f"`{label}`").cast("int").alias("label")).filter(
        "k IS NOT NULL AND label IN (0, 1) AND crc32(cast(cast(k AS string) AS binary)) % 5 <> 0"
    ).groupBy("k").agg(F.min("label").alias("label"))
    order = [F.xxhash64("k"), F.col("k")]
    rows = [usable.filter(F.col("label") == c).orderBy(*order).limit(per_class).collect() for c in (0, 1)]
    picked = {r["k"]: r["label"] for part in rows for r in part}
    if not picked:
        return Model(np.zeros(ALL_BUCKETS), 0.0)
    spark = docs.sparkSession
    chosen = spark.createDataFrame(list(picked.items()), f"`__k` {usable.schema['k'].dataType.simpleString()}, label int")
    texts = docs.select(k.alias("__k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "__k").groupBy("__k", "label").agg(F.min("text").alias("text"))
    first = Window.partitionBy("label").orderBy(F.xxhash64("__k"), "__k")  # per_class rows at most
    sample = sample.withColumns({"before": F.sum(F.octet_length("text")).over(first), "place": F.row_number().over(first)})
    sample = sample.filter((F.col("place") == 1) | (F.col("before") <= SAMPLE_BYTES)).select(F.col("__k").cast("string").alias("k"), "label", "text")
    table = sample.mapInArrow(chunked(_bag_batch, "text"), "k string, label int, bag binary, share binary").toArrow()
    table = table.sort_by("k")  # the order of training must not depend on partitioning
    y = table["label"].to_numpy()
    if len(set(y)) < 2:
        p = (np.sum(y == 1) + 1e-3) / (len(y) + 2e-3) if len(y) else 0.5
        return Model(np.zeros(ALL_BUCKETS), float(np.log(p / (1 - p))))
    bags = [np.frombuffer(b, np.uint32) for b in table["bag"].to_pylist()]
    shares = [np.frombuffer(b, np.float32) for b in table["share"].to_pylist()]
    return train_bags(bags, shares, y)


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``__row`` (the columns in ``carry``, or all) and ``score`` for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # ALL_BUCKETS doubles, whatever the input
    return map_texts(docs, text, carry, lambda column: {"score": pa.array(held.value.score(column), pa.float64())}, "score double")
