"""Spelling variants: words one edit apart, found by the one-edit neighbourhoods of their reduced forms.

The letters are hashed to a few symbols, as evenly as their counts allow; the number of symbols grows with the seventh root
of the vocabulary, so that words of seven letters have few strangers in their neighbourhood. Words that are one edit apart have
reduced forms that are equal or one edit apart. For every distinct reduced form the full neighbourhood (itself, each letter left out,
each replaced, each put in) is generated as 64-bit hashes, in arrays and without writing strings. Those that the vocabulary may
have, by a bitmap of its reduced forms, are joined with it, and the pairs of words are verified on the words themselves.

A reduced form that more than ``CROWD`` words share would bring pairs by the square. Its words are searched with all letters as
symbols of their own, where neighbours are true ones; pairs that the rest of the vocabulary has with them are these, reversed. No word is
left out on either way.

Forms lead to words of at least ``FACTOR`` times the count, so chains are short; they are followed by pointer doubling.

Nulls and edges: a null text has no words; a null id is written as nothing; repeated rows count each; texts of any length are read
whole, long ones in spans; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import join_dealt
from tidemark.llm.runtime import materialize
from tidemark.llm.textbatch import mix, spans

MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
#: One run in so many, by its hash with the document's id, loses a letter.
SLIP = 31
#: Possible reduced forms of seven letters for each word, so that few strangers meet at any size of the vocabulary.
SPARSE = 32
LEAST_SYMBOLS = 4
#: Words of one reduced form above which they are searched letter by letter.
CROWD = 512
#: Bits of the bitmap: 16 for each reduced form, in these bounds (8 KB to 32 MB). A full bitmap only lets more hashes into the join.
BITS = (16, 28)
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
_CELLS = 1 << 21

#: All letters of a word after lower-casing.
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}")
_LOWER = {i: i + 32 for i in range(65, 91)}
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_CODE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, len(LETTERS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = 0xA24BAED4963EE407


def runs_of(text: str) -> Iterator[str]:
    """The maximal runs of letters that have the least length, a long text span by span."""
    if len(text) < 1 << 20:
        yield from _RUN.findall(text)
        return
    raw = text.encode()
    for a, b in spans(raw):
        yield from _RUN.findall(raw[a:b].decode())


def slipped(run: str, doc: int) -> str:
    """A lower-cased run as the document has it; ``doc`` is the checksum of the id and a colon."""
    h = zlib.crc32(run.encode(), doc)
    return run if h % SLIP else run[: h % len(run)] + run[h % len(run) + 1 :]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of all words of the least length and count."""
    told = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.col(f"`{text}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, t in zip(batch.column(0), batch.column(1)):
                if not t.is_valid:
                    continue
                at, own = zlib.crc32(f"{doc.as_py()}:".encode()), Counter()
                for r, n in Counter(runs_of(t.as_py())).items():
                    own[r.lower() if r.isascii() else r.translate(_LOWER)] += n
                for r, n in own.items():
                    w = slipped(r, at)
                    if len(w) >= MIN_LENGTH:
                        found[w] += n
                if len(found) > HELD_WORDS:
                    yield made()
                    found.clear()
        yield made()

    counted = told.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= MIN_COUNT)


# --- reduced forms -------------------------------------------------------------

def letter_counts(words: DataFrame) -> dict[str, int]:
    """How often each letter stands in the vocabulary; 90 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter("".join(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["letter", "n"])

    rows = words.select("word").mapInArrow(run, "letter string, n bigint").groupBy("letter").agg(F.sum("n").alias("n"))
    return {r["letter"]: r["n"] for r in rows.collect()}


def symbols(counts: dict[str, int], n_symbols: int) -> np.ndarray:
    """The symbol of each letter of ``LETTERS``: the most frequent first, each to the symbol that has least so far."""
    load, out = [0] * n_symbols, np.zeros(len(LETTERS), np.int64)
    for letter in sorted(LETTERS, key=lambda x: (-counts.get(x, 0), x)):
        s = min(range(n_symbols), key=lambda k: (load[k], k))
        out[LETTERS.index(letter)] = s
        load[s] += counts.get(letter, 0) + 1
    return out


def n_symbols(words: int) -> int:
    return min(len(LETTERS), max(LEAST_SYMBOLS, int(np.ceil((SPARSE * max(words, 1)) ** (1 / MIN_LENGTH)))))


_AT = np.full(0x100, -1, np.int64)
_AT[[ord(x) for x in LETTERS]] = np.arange(len(LETTERS))


def _matrix(words: list[str], symbol: np.ndarray) -> np.ndarray:
    """The symbols of words of one length."""
    points = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return symbol[_AT[points]].reshape(len(words), -1)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _closed(raw: np.ndarray, length: int) -> np.ndarray:
    return mix(raw + np.uint64(length * _SALT & (1 << 64) - 1))


def reduced(sym: np.ndarray) -> np.ndarray:
    """The hash of each row of symbols."""
    return _closed((_CODE[sym] * _powers(sym.shape[1])).sum(axis=1, dtype=np.uint64), sym.shape[1])


def neighbourhood(sym: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and hashes of all rows of symbols, of ``k`` kinds, that are equal to or one edit from each row.

    A polynomial over the symbols: an edit changes one term and shifts those behind it. Rows and places go in blocks, so that
    arrays stay small whatever the length of a word.
    """
    n, length = sym.shape
    power, back = _powers(length + 1), np.uint64(_BACK)
    term = _CODE[sym] * power[:length]
    upto = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(term, axis=1, dtype=np.uint64)], axis=1)
    whole = upto[:, -1]
    yield np.arange(n), _closed(whole, length)
    # Leaving out one of several equal symbols side by side gives one form, and so does putting in another beside them.
    fresh = np.ones((n, length), bool)
    fresh[:, 1:] = sym[:, 1:] != sym[:, :-1]
    row, at = np.nonzero(fresh)
    yield row, _closed(upto[row, at] + (whole[row] - upto[row, at + 1]) * back, length - 1)
    base = np.uint64(_BASE)
    for lo in range(0, length + 1, max(1, _CELLS // (n * k))):
        hi = min(length + 1, lo + max(1, _CELLS // (n * k)))
        rest = upto[:, lo:hi] + (whole[:, None] - upto[:, lo:hi]) * base
        for s in range(k):
            put = np.ones((n, hi - lo), bool)
            before = sym[:, max(lo - 1, 0) : hi - 1]
            put[:, hi - lo - before.shape[1] :] = before != s
            row, at = np.nonzero(put)
            yield row, _closed(rest[row, at] + _CODE[s] * power[lo + at], length + 1)
            row, at = np.nonzero(sym[:, lo:hi] != s)
            yield row, _closed(whole[row] + (_CODE[s] - _CODE[sym[row, lo + at]]) * power[lo + at], length)


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        if not len(group):
            continue
        step = max(1, _CELLS // 16 // int(lengths[group[0]]))
        for at in range(0, len(group), step):
            yield group[at : at + step]


def with_form(words: DataFrame, symbol: np.ndarray, name: str) -> DataFrame:
    """The words with the hash of their reduced form."""
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column("word").to_pylist()
            out = np.zeros(len(told), np.uint64)
            for group in _by_length(told):
                out[group] = reduced(_matrix([told[i] for i in group], symbol))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], names=[*batch.schema.names, name])

    return words.mapInArrow(run, f"{kept}, {name} bigint")


def _bitmap(forms: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Which top bits the hashes of all forms have: built in parts by the tasks, joined by bit, at most 2^28 bits."""
    bits = int(min(max(BITS[0], np.ceil(np.log2(max(n, 1) * 16))), BITS[1]))
    place = F.shiftrightunsigned("form", 64 - bits)
    parts = forms.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))).alias("bits"))
    told = parts.toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[told.column("at").to_numpy()] = told.column("bits").to_numpy()
    return out, bits


def _search(forms: DataFrame, symbol: np.ndarray, bitmap: np.ndarray, bits: int) -> DataFrame:
    """``form`` and ``near``: every hash in the neighbourhood of each form's word that the bitmap may have."""
    held = forms.sparkSession.sparkContext.broadcast(bitmap)
    k = int(symbol.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, shift = held.value.view(np.uint64), np.uint64(64 - bits)
        for batch in batches:
            told, form = batch.column("word").to_pylist(), batch.column("form").to_numpy()
            for group in _by_length(told):
                sym = _matrix([told[i] for i in group], symbol)
                own = form[group]
                for row, near in neighbourhood(sym, k):
                    place = near >> shift
                    ok = there[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) != 0
                    if ok.any():
                        yield pa.RecordBatch.from_arrays([pa.array(own[row[ok]]), pa.array(near[ok].view(np.int64))], names=["form", "near"])

    return forms.mapInArrow(run, "form bigint, near bigint")


def _verified(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.levenshtein("word", "other", 1) == 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """``word``, ``other`` and its count ``m``: every pair of words one edit apart, in both directions. ``words`` has ``word`` and ``n``."""
    total = words.count()
    symbol = symbols(letter_counts(words), n_symbols(total))
    words = materialize(with_form(words, symbol, "form"), "forms")
    forms = words.groupBy("form").agg(F.min("word").alias("word"), F.count("*").alias("size"))
    forms = materialize(forms, "reduced")
    sizes = forms.agg(F.count("*").alias("n"), F.max("size").alias("most")).first()
    plain = words
    if (sizes["most"] or 0) > CROWD:
        crowds = forms.filter(F.col("size") > CROWD).select("form")
        crowded = materialize(join_dealt(words, crowds.withColumn("there", F.lit(True)), "form", "word", total, counts=words).drop("there"), "crowded")
        plain = materialize(join_dealt(words, crowds.withColumn("there", F.lit(True)), "form", "word", total, counts=words, how="left").filter("there IS NULL").drop("there"), "plain")
        forms = forms.filter(F.col("size") <= CROWD)
    probes = _search(forms.select("form", "word"), symbol, *_bitmap(forms, sizes["n"]))
    others = plain.select(F.col("form").alias("near"), F.col("word").alias("other"), F.col("n").alias("m"))
    pairs = _verified(probes.join(others, "near").join(plain.select("form", "word"), "form").select("word", "other", "m"))
    if plain is words:
        return pairs
    every = np.arange(len(LETTERS))
    exact = materialize(with_form(words.select("word", "n", F.col("form").alias("crowd")), every, "form"), "letters")
    mine = exact.join(crowded.select("word"), "word", "left_semi").select("form", "word", F.col("n").alias("own"))
    found = _search(mine.select("form", "word"), every, *_bitmap(exact, total))
    theirs = exact.select(F.col("form").alias("near"), F.col("word").alias("other"), F.col("n").alias("m"))
    out = materialize(_verified(found.join(theirs, "near").join(mine, "form").select("word", "own", "other", "m")), "crowd-pairs")
    back = out.join(crowded.select(F.col("word").alias("other")), "other", "left_anti").select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("own").alias("m"))
    return pairs.unionByName(out.select("word", "other", "m")).unionByName(back)


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain. ``forms`` has ``word`` and ``form``, which leads to a greater count, so chains end."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "chains")
    total = at.count()
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = join_dealt(at, on, "root", "word", total, counts=at, how="left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        moved = materialize(moved, "chains")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of the vocabulary."""
    words = materialize(vocabulary(docs, key, text), "words")
    # Of the near words, the greatest count and then the least word: code-point order is that of UTF-8 bytes.
    best = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b"))
    leads = -F.col("b")["m"] >= FACTOR * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(leads, F.col("b")["other"]).alias("form"), F.when(leads, -F.col("b")["m"]).alias("form_n"),
    )
    told = materialize(told, "variants")
    roots = _roots(told.filter("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
