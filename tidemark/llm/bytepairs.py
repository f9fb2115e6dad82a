"""Byte-level BPE encoding and decoding by a file of ranks.

A text is split by a pattern; every match is encoded by itself, as the tiktoken library does: a match that is a
token is that token, any other starts as single bytes and merges, again and again, its leftmost pair of
least rank. Matches of like length are rows of padded matrices. In each round every row merges its
leftmost minimum-rank pair: ranks come from a hashed table of pairs, the gap that a merge leaves is closed, and rows that
are done leave the matrix. Matches of more than ``MATRIX_WIDTH`` bytes use a heap, whose work does not
grow with the square of their length.

Texts of more than a span are cut before white space that follows other characters, which no match reaches across.
A worker keeps encoded matches for reuse.

Nulls and edges: a null text counts as empty; an empty text has no ids and decodes to no bytes; texts of any
length are encoded whole; repeated rows are encoded each; strings that look like special tokens are text; an empty table gives an
empty result; other columns are carried in a struct, whatever their names. Decoding refuses ids that the file does not have.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.textbatch import CHUNK_BYTES, map_texts

#: Matches of more bytes than this use a heap instead of a matrix.
MATRIX_WIDTH = 128
#: Encoded matches that a worker keeps; a batch that mostly misses them starts the collection anew.
CACHE_UNITS = 300_000
STALE_SHARE = 0.5
_NONE = np.iinfo(np.int32).max
_EMPTY = np.int64(-1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_CUT = regex.compile(r"(?<=\S)\s")


class PairTable:
    """(left, right) -> merged token, as an open-addressed table that whole arrays look up at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(8, int(2 * len(merged)).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        at, waiting = self._home(keys), np.arange(len(keys))
        self.probes = 0
        while len(waiting):  # each step places one key in every free slot that some key wants
            self.probes += 1
            free = self.keys[at[waiting]] == _EMPTY
            slots, first = np.unique(at[waiting[free]], return_index=True)
            placed = waiting[free][first]
            self.keys[slots], self.values[slots] = keys[placed], merged[placed]
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            at[waiting] = at[waiting] + 1 & (1 << self.bits) - 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _GOLDEN >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, whose id is its rank; the largest integer where there is none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(len(keys), _NONE, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._home(keys[open_])
        while len(open_):
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (there != _EMPTY)
            open_, at = open_[on], at[on] + 1 & (1 << self.bits) - 1
        return out


class Ranks:
    """A file of ranks, its pairs, and an encoder over the matches of a pattern."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        if sorted(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError("ranks are not 0, 1, 2 and so on")
        self.tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("some byte is no token")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.matches = regex.compile(pattern).findall
        #: Each way to cut a token into two: several pairs may give one token.
        self.merges = {
            (a, b): r for t, r in self.ranks.items() for k in range(1, len(t))
            if (a := self.ranks.get(t[:k])) is not None and (b := self.ranks.get(t[k:])) is not None
        }
        pairs = np.array(list(self.merges), np.int32).reshape(-1, 2)
        self.table = PairTable(pairs[:, 0], pairs[:, 1], np.fromiter(self.merges.values(), np.int32, len(self.merges)))
        #: Encoded matches, as the bytes of their ids.
        self.ids_of: dict[str, bytes] = {}
        #: Ids in decimal with a comma behind, right-aligned in zero bytes.
        width = len(str(len(self.tokens))) + 1
        self.decimal = np.frombuffer(b"".join(f"{i},".encode().rjust(width, b"\0") for i in range(len(self.tokens))), np.uint8).reshape(-1, width)

    def agenda(self, unit: bytes) -> np.ndarray:
        """Merge one match with a heap of (rank, place)."""
        symbols = self.byte_ids[np.frombuffer(unit, np.uint8)].tolist()
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        first = self.table.find(np.array(symbols[:-1], np.int32), np.array(symbols[1:], np.int32)).tolist()
        heap = [(r, k) for k, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        merges = self.merges
        while heap:
            r, a = heapq.heappop(heap)
            b = right[a]
            if symbols[a] < 0 or b >= n or merges.get((symbols[a], symbols[b])) != r:
                continue  # one of the pair has merged since
            symbols[a], symbols[b] = r, -1
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
                new = merges.get((r, symbols[right[b]]))
                if new is not None:
                    heapq.heappush(heap, (new, a))
            if left[a] >= 0:
                new = merges.get((symbols[left[a]], r))
                if new is not None:
                    heapq.heappush(heap, (new, left[a]))
        return np.array([s for s in symbols if s >= 0], np.int32)

    def matrix(self, units: list[bytes]) -> list[np.ndarray]:
        """Merge matches together, each a row of a matrix padded with -1."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        columns = np.arange(lengths.max())
        sym = np.full((len(units), len(columns)), -1, np.int32)
        sym[columns < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(units), np.uint8)]
        rank = self.table.find(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(units), -1)
        live, out = np.arange(len(units)), [None] * len(units)
        while len(live):
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(live), np.int64)
            rows = np.arange(len(live))
            more = rank[rows, best] != _NONE if rank.shape[1] else np.zeros(len(live), bool)
            for k in np.flatnonzero(~more):
                out[live[k]] = sym[k, : lengths[live[k]]]
            if not more.all():
                live, sym, rank, best = live[more], sym[more], rank[more], best[more]
                rows = np.arange(len(live))
                if not len(live):
                    break
            lengths[live] -= 1
            width = int(lengths[live].max())
            # The right one of the pair goes, what is behind it moves up; columns that no row needs any more are left out.
            merged = rank[rows, best]
            keep = columns[None, :width] + (columns[None, :width] > best[:, None])
            sym = np.take_along_axis(sym, keep, axis=1)
            sym[rows, best] = merged
            rank = np.take_along_axis(rank, np.minimum(keep[:, : width - 1], rank.shape[1] - 1), axis=1)
            for side in (best - 1, best):
                ok = np.flatnonzero((side >= 0) & (side < width - 1))
                rank[ok, side[ok]] = self.table.find(sym[ok, side[ok]], sym[ok, side[ok] + 1])
        return out

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """The ids of new matches: by length, in runs whose rows differ little in length."""
        found: dict[str, bytes] = {}
        todo: list[tuple[bytes, str]] = []
        for u in units:
            raw = u.encode()
            whole = self.ranks.get(raw)
            if whole is None:
                todo.append((raw, u))
            else:
                found[u] = np.int32(whole).tobytes()
        todo.sort(key=lambda x: len(x[0]))
        lengths = [len(raw) for raw, _ in todo]
        steps = [*range(2, 16), *range(16, 64, 8), *range(64, MATRIX_WIDTH + 1, 16)]
        cuts = [0, *np.searchsorted(lengths, steps, "right").tolist()]
        for a, b in zip(cuts[:-1], cuts[1:]):
            for at in range(a, b, 1 << 14):
                some = todo[at : min(b, at + (1 << 14))]
                for (_, u), ids in zip(some, self.matrix([raw for raw, _ in some])):
                    found[u] = ids.tobytes()
        for raw, u in todo[cuts[-1] :]:
            found[u] = self.agenda(raw).tobytes()
        return found

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.matches(t) for t in texts]
        units = list(chain.from_iterable(cut))
        ends = np.cumsum([0, *map(len, cut)]).tolist()
        found = list(map(self.ids_of.get, units))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = self.learn(list({units[i] for i in missing}))
            for i in missing:
                found[i] = new[units[i]]
            if len(self.ids_of) >= CACHE_UNITS and len(missing) > STALE_SHARE * len(units):
                self.ids_of.clear()
            if len(self.ids_of) < CACHE_UNITS:
                self.ids_of.update((u, ids) for u, ids in new.items() if len(u) <= MATRIX_WIDTH)
        return [np.frombuffer(b"".join(found[a:b]), np.int32) for a, b in zip(ends[:-1], ends[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; refuses ids that are not in the file."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(self.tokens):
            raise ValueError("an id is not in the file of ranks")
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def spelled(self, ids: np.ndarray) -> bytes:
        """Decimal ids, each with a comma behind."""
        digits = self.decimal[ids].ravel()
        return digits[digits != 0].tobytes()


def spans(text: str, limit: int = CHUNK_BYTES) -> Iterator[str]:
    """Parts of about ``limit`` characters that no match of the pattern reaches across."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + limit) if at + limit < len(text) else None
        stop = cut.start() if cut else len(text)
        yield text[at:stop]
        at = stop


@lru_cache(maxsize=2)
def _ranks(raw: bytes, pattern: str) -> Ranks:
    return Ranks(raw, pattern)


def load(path: str, pattern: str) -> Ranks:
    with open(path, "rb") as f:
        return _ranks(f.read(), pattern)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", carry: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """``__row`` and, for each text: ``n_tokens``, ``ids_sha256`` (of decimal ids joined by commas), ``decoded_sha256``, and ``ids`` if asked.

    The file of ranks is read by the driver and broadcast (its size is fixed).
    """
    with open(ranks_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(column: pa.Array) -> dict[str, pa.Array]:
        r = _ranks(held.value, pattern)
        texts = [t or "" for t in column.to_pylist()]
        one = len(texts) == 1 and len(texts[0]) > 2 * CHUNK_BYTES
        parts = ((i, ids) for i, ids in enumerate(r.encode_batch(texts))) if not one else ((0, r.encode_batch([s])[0]) for s in spans(texts[0]))
        sizes, all_ids = [0] * len(texts), [[] for _ in texts]
        told, said = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for i, ids in parts:
            if len(ids):
                told[i].update((b"," if sizes[i] else b"") + r.spelled(ids)[:-1])
                said[i].update(r.decode(ids))
                sizes[i] += len(ids)
                if with_ids:
                    all_ids[i].append(ids)
        made = {
            "n_tokens": pa.array(sizes, pa.int64()),
            "ids_sha256": pa.array([h.hexdigest() for h in told], pa.string()),
            "decoded_sha256": pa.array([h.hexdigest() for h in said], pa.string()),
        }
        return made | ({"ids": _lists([np.concatenate(x) if x else np.zeros(0, np.int32) for x in all_ids])} if with_ids else {})

    more = ", ids array<int>" if with_ids else ""
    return map_texts(docs, text, carry, run, f"n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the bytes of their ids (none for a null list)."""
    with open(ranks_path, "rb") as f:
        held = rows.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in rows.columns if c != "decoded"]
    kept = rows.select(*[rows[c] for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _ranks(held.value, pattern)
        for batch in batches:
            lists = batch.column(names.index(ids)).to_pylist()
            decoded = pa.array([r.decode(np.array(x or [], np.int64)) for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, decoded binary")
