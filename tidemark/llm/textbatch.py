"""Vectorised text primitives over Arrow string batches.

A batch of texts is viewed as one UTF-8 byte array plus offsets. Words are the
maximal runs of bytes other than 0x20 and 0x09-0x0D; they are hashed with a
positional polynomial over random byte codes, so one cumulative sum yields the
hash of every word, line or character n-gram of the batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once; bounds the temporary arrays of a Python worker.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_RNG = np.random.Generator(np.random.PCG64(20240229))
_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), CHUNK_BYTES)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets, from 0; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    bufs = column.buffers()
    if len(column) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(bufs[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def _cut(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    _, off = text_buffer(column)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, end - at
        at = end


def spans(raw: bytes, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a text into ranges of about ``limit`` bytes that end before white space; a longer word stays whole."""
    at = 0
    while at < len(raw):
        stop = len(raw)
        if at + limit < len(raw):
            blank = _BLANK.search(raw, at + limit)
            stop = blank.start() if blank else stop
        yield at, stop
        at = stop


def is_long(column: pa.Array) -> bool:
    """Whether a slice is one text that is to be worked on in spans."""
    return len(column) == 1 and int(text_buffer(column)[1][-1]) > 2 * CHUNK_BYTES


def word_hashes_of(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the texts, the row of each, and the number of words of each row; a long text goes span by span."""
    if not is_long(column):
        t = Texts(column, lower)
        return t.word_hashes(), t.doc, t.n_words
    raw = text_buffer(column)[0].tobytes()
    words = np.concatenate([Texts(pa.array([raw[a:b]], pa.binary()), lower).word_hashes() for a, b in spans(raw)])
    return words, np.zeros(len(words), np.int64), np.array([len(words)])


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text, one row at least."""
    for at, n in _cut(batch.column(batch.schema.get_field_index(column)), limit):
        yield batch.slice(at, n)


def chunked(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str) -> Callable:
    """A ``mapInArrow`` function that applies ``fn`` to each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column):
                yield fn(piece)

    return run


def map_texts(docs: DataFrame, text: str, carry: list[str] | None, fn: Callable[[pa.Array], dict[str, pa.Array]], schema: str) -> DataFrame:
    """``__row`` (the columns in ``carry``, or all, as a struct) and what ``fn`` makes of each slice of texts.

    Packing the columns keeps their names apart from those of the results. A carried text column is read from
    the struct, so that it is sent to Python once.
    """
    names = list(dict.fromkeys(carry or docs.columns))
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    inside = text in names and docs.schema[text].dataType.simpleString() == "string"
    packed = docs.select(row) if inside else docs.select(row, F.col(f"`{text}`").cast("string").alias("__text"))
    place = names.index(text) if inside else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            column = batch.column(1) if place is None else rows.field(place)
            for at, n in _cut(column, CHUNK_BYTES):
                made = fn(column.slice(at, n))
                yield pa.RecordBatch.from_arrays([rows.slice(at, n), *made.values()], names=["__row", *made])

    row_type = packed.schema["__row"].dataType.simpleString()
    return packed.mapInArrow(run, f"__row {row_type}, {schema}")


class Texts:
    """Words, characters and lines of a column of texts."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.off = text_buffer(column)
        self.data = LOWER[data] if lower else data
        self.n = len(column)
        n = len(data)
        self._pow, self._inv = _power(n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[self.data] * self._pow[:n], out=self._sum[1:])
        space = SPACE[self.data]
        self.space = space
        if n:
            before = np.empty(n, bool)
            before[0], before[1:] = True, space[:-1]
            first = self.off[:-1]
            before[first[first < n]] = True
            after = np.empty(n, bool)
            after[-1], after[:-1] = True, space[1:]
            last = self.off[1:] - 1
            after[last[last >= 0]] = True
            self.starts = np.flatnonzero(~space & before)
            self.ends = np.flatnonzero(~space & after) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.doc = self.owner(self.starts)
        self.n_words = np.bincount(self.doc, minlength=self.n)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The row that byte positions belong to."""
        return np.searchsorted(self.off, at, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
        raw = (self._sum[ends] - self._sum[starts]) * self._inv[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have their flag set."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]

    def word_spans(self) -> np.ndarray:
        """Index of the first word of each row, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.n_words)])


def windows(word_hash: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start index and hash of every window of ``k`` consecutive words within one row."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = word_hash[:n].copy()
    for j in range(1, k):
        out = out * _WORD_BASE + word_hash[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return at, mix(out[at])
