"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the vocabulary asks (spaces become U+2581, one is put in
front), cut where no piece of the vocabulary reaches across, and every unit is
merged by an agenda of adjacent symbol pairs: the pair whose union has the best
score goes first, the leftmost among equals. Units of a batch run through
their agendas together as rows of a rank matrix; long units use a heap. Symbols outside
the vocabulary fall back to bytes.

Each Arrow batch checks its new units against the sentencepiece library, in one
call; a difference raises. A worker keeps encoded units for reuse.

Nulls and edges: a null text counts as empty; an empty text has the end id
alone and decodes to an empty text; texts of any length are encoded whole; repeated
rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tidemark.llm.textbatch import map_texts

MARK = "▁"
#: Units that a worker keeps, the first that it meets; a batch that mostly misses them starts the collection anew.
CACHE_UNITS = 300_000
STALE_SHARE = 0.5
#: Units of more symbols than this use a heap instead of the matrix.
MATRIX_WIDTH = 48
_NONE = np.iinfo(np.int32).max
_TABLE_BITS = 19


class Pieces:
    """A vocabulary, its merges and an encoder over cut units."""

    def __init__(self, model: bytes):
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, size = self.lib, self.lib.vocab_size()
        if lib.encode("a b") != lib.encode("a" + MARK + "b") or lib.decode(lib.encode(" a ")) != " a ":
            raise ValueError("the vocabulary's normaliser is not the identity")
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(lib.is_byte(i) for i in self.byte_ids):
            raise ValueError("the vocabulary has no byte pieces")

        # Symbols: ids of pieces; single characters that are no piece come after them.
        self.symbol = dict(self.ids)
        for p in self.ids:
            for ch in p:
                self.symbol.setdefault(ch, size + len(self.symbol))
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank_of = np.full(size, _NONE, np.int32)
        self.merges: dict[tuple[int, int], int] = {}
        for p, i in self.ids.items():
            self.rank_of[i] = order[scores[p]]
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    self.merges[a, b] = i
        self._table()
        self._cuts()
        #: Encoded units, as the bytes of their ids.
        self.ids_of: dict[str, bytes] = {}
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        #: Ids in decimal with a space behind, right-aligned in zero bytes.
        width = len(str(size)) + 1
        self.decimal = np.frombuffer(b"".join(f"{i} ".encode().rjust(width, b"\0") for i in range(size)), np.uint8).reshape(size, width)
        self.symbol_at = np.full(0x110000, -1, np.int32)
        for ch, i in self.symbol.items():
            if len(ch) == 1:
                self.symbol_at[ord(ch)] = i

    def _table(self) -> None:
        """The merges as an open-addressed table for whole arrays of pairs."""
        self.keys = np.full(1 << _TABLE_BITS, -1, np.int64)
        self.values = np.zeros(1 << _TABLE_BITS, np.int32)
        self.probes = 1
        for (a, b), i in self.merges.items():
            key = a << 20 | b
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - _TABLE_BITS
            steps = 1
            while self.keys[at] >= 0:
                at = at + 1 & (1 << _TABLE_BITS) - 1
                steps += 1
            self.keys[at], self.values[at] = key, i
            self.probes = max(self.probes, steps)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols merges to, or -1; symbols below 0 merge with nothing."""
        key = a.astype(np.int64) << 20 | b
        at = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        out = np.full(len(key), -1, np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        for _ in range(self.probes):
            there = self.keys[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
            if not len(open_):
                break
            at[open_] = at[open_] + 1 & (1 << _TABLE_BITS) - 1
        return out

    def _cuts(self) -> None:
        """Where units may end: before U+2581, around line feeds, between a letter and punctuation that follows no letter in any piece."""
        pairs = {(p[k], p[k + 1]) for p in self.ids for k in range(len(p) - 1)}
        if any(b == MARK and a != MARK for a, b in pairs) or any("\n" in ab for ab in pairs):
            raise ValueError("pieces reach across words or lines")
        letter = re.compile(r"[^\W\d_]").match
        marks = set(string.punctuation) - {b for a, b in pairs if letter(a)}
        self.marks = "".join(sorted(marks))
        # A word of letters alone ends before such a mark; all other units end before a mark of U+2581 or a line feed.
        stop = f"[{re.escape(self.marks)}{MARK}\n]"
        self.units = re.compile(f"\n|{MARK}*[^\\W\\d_]+(?={stop}|\\Z)|{MARK}*[^{MARK}\n]+|{MARK}+").findall

    def cut(self, text: str) -> list[str]:
        return self.units(MARK + text.replace(" ", MARK)) if text else []

    def _spell(self, symbols: list[int], unit: str) -> bytes:
        """The bytes of the ids of merged symbols; characters that are no piece become byte pieces."""
        out, at = [], 0
        for s in symbols:
            if 0 <= s < len(self.rank_of):
                out.append(s)
                at += len(self.lib.id_to_piece(s))
            else:
                out += [self.byte_ids[b] for b in unit[at].encode()]
                at += 1
        return np.array(out, self.kind).tobytes()

    def agenda(self, unit: str) -> bytes:
        """Merge one unit with a heap of (rank, place) entries."""
        symbols = [self.symbol.get(ch, -1) for ch in unit]
        left, right = list(range(-1, len(unit) - 1)), list(range(1, len(unit) + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(symbols):
                i = self.merges.get((symbols[a], symbols[b]))
                if i is not None:
                    heapq.heappush(heap, (int(self.rank_of[i]), a, b, i))

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        gone = -2
        while heap:
            _, a, b, i = heapq.heappop(heap)
            if symbols[a] == gone or symbols[b] == gone or right[a] != b or self.merges.get((symbols[a], symbols[b])) != i:
                continue
            symbols[a], symbols[b] = i, gone
            right[a] = right[b]
            if right[b] < len(symbols):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return self._spell([s for s in symbols if s != gone], unit)

    def agendas(self, units: list[str]) -> list[bytes]:
        """Merge units of at most ``MATRIX_WIDTH`` symbols together; each row of the matrices is one agenda."""
        width = max(map(len, units))
        sym = np.full((len(units), width), -1, np.int32)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym[np.arange(width) < lengths[:, None]] = self.symbol_at[points]
        out = sym.copy()
        size = lengths.copy()
        live = np.arange(len(units))
        piece = self.merged(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(units), width - 1)
        rank = np.where(piece >= 0, self.rank_of[piece], _NONE)
        columns = np.arange(width)
        while len(live) and rank.shape[1]:
            best = rank.argmin(axis=1)
            rows = np.arange(len(live))
            more = rank[rows, best] < _NONE
            if not more.all():
                done = live[~more]
                out[done, : sym.shape[1]] = sym[~more]
                live, sym, piece, rank, best = live[more], sym[more], piece[more], rank[more], best[more]
                rows = np.arange(len(live))
                if not len(live):
                    break
            size[live] -= 1
            # Close the gap that the right symbol leaves, then look up the two new pairs.
            new = piece[rows, best]
            shift = columns[None, : sym.shape[1] - 1] + (columns[None, : sym.shape[1] - 1] > best[:, None])
            sym = np.take_along_axis(sym, shift, axis=1)
            sym[rows, best] = new
            if sym.shape[1] == 1:
                out[live, :1] = sym
                break
            keep = shift[:, : piece.shape[1] - 1]
            piece, rank = np.take_along_axis(piece, keep, axis=1), np.take_along_axis(rank, keep, axis=1)
            for side in (best - 1, best):
                ok = np.flatnonzero((side >= 0) & (side < piece.shape[1]))
                found = self.merged(sym[ok, side[ok]], sym[ok, side[ok] + 1])
                piece[ok, side[ok]] = found
                rank[ok, side[ok]] = np.where(found >= 0, self.rank_of[found], _NONE)
        used = columns < size[:, None]
        plain = (~used | (out >= 0) & (out < len(self.rank_of))).all(axis=1)
        item = np.dtype(self.kind).itemsize
        raw = out.astype(self.kind).tobytes()
        at, ends = np.arange(len(units)) * width * item, (np.arange(len(units)) * width + size) * item
        ids = [raw[a:b] for a, b in zip(at.tolist(), ends.tolist())]
        for k in np.flatnonzero(~plain):
            ids[k] = self._spell(out[k, : size[k]].tolist(), units[k])
        return ids

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """Encode new units and check them against the library."""
        units.sort(key=len)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        found: list[bytes] = []
        # Groups of like lengths, so that rows of a matrix need little padding.
        steps = [1, *range(2, 16), *range(16, MATRIX_WIDTH, 8), MATRIX_WIDTH]
        cuts = [0, *np.searchsorted(lengths, steps, "right").tolist(), len(units)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if lengths[b - 1] > MATRIX_WIDTH:
                found += map(self.agenda, units[a:b])
            elif lengths[b - 1] == 1:
                found += [self._spell([self.symbol.get(u, -1)], u) for u in units[a:b]]
            else:
                found += self.agendas(units[a:b])
        self.check(units, found)
        return dict(zip(units, found))

    def check(self, units: list[str], found: list[bytes]) -> None:
        """Compare with the library: units stand on lines of one text, which no piece reaches across."""
        if "\n" in units:
            at = units.index("\n")
            units, found = units[:at] + units[at + 1 :], found[:at] + found[at + 1 :]
        feed = np.array([self.byte_ids[10]], self.kind).tobytes()
        want = np.array([self.lib.piece_to_id(MARK)], self.kind).tobytes() + feed + feed.join([*found, b""])
        if np.array(self.lib.encode("\n" + "\n".join([*units, ""])), self.kind).tobytes() != want:
            raise ValueError("ids differ from those of the sentencepiece library")

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, without an end."""
        cut = [self.cut(t or "") for t in texts]
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
                self.ids_of.update(new)
        return [np.frombuffer(b"".join(found[a:b]), self.kind) for a, b in zip(ends[:-1], ends[1:])]

    def spelled(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        digits = self.decimal[ids].ravel()
        return digits[digits != 0].tobytes()[:-1]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def load(path: str) -> Pieces:
    with open(path, "rb") as f:
        return _pieces(f.read())


def encode(docs: DataFrame, model_path: str, text: str = "text", carry: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """``__row`` and, for each text: ``n_tokens`` (with the end id), ``ids_sha256``, ``decoded_sha256``, and ``ids`` if asked.

    The vocabulary file is read by the driver and broadcast (its size is fixed).
    """
    with open(model_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(column: pa.Array) -> dict[str, pa.Array]:
        p = _pieces(held.value)
        end = p.lib.eos_id()
        all_ids = [np.append(ids, p.kind(end)) for ids in p.encode_batch(column.to_pylist())]
        decoded = p.lib.decode([ids.tolist() for ids in all_ids])
        ids_sha = [hashlib.sha256(p.spelled(ids)).hexdigest() for ids in all_ids]
        made = {
            "n_tokens": pa.array([len(ids) for ids in all_ids], pa.int64()),
            "ids_sha256": pa.array(ids_sha, pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
        }
        return made | ({"ids": _lists(all_ids)} if with_ids else {})

    more = ", ids array<int>" if with_ids else ""
    return map_texts(docs, text, carry, run, f"n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
