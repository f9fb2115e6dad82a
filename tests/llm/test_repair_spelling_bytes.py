"""Conversation repair, spelling variants and byte-level BPE against brute force and the library."""

import base64
import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bytepairs, queries, repair, spelling

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
LOWER = {i: i + 32 for i in range(65, 91)}


# --- op13 ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library(library):
    ranks, rng = bytepairs.load(RANKS, PATTERN), random.Random(1)
    parts = ["a", "e", "th", "ing", " ", "  ", "\n", "é", "日本", "😀", "'s", "1", "23", "!", "<|endoftext|>", "\t", "\r", "\x00", "\x1c", " ", "ΰ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(1500)]
    for text, ids in zip(texts, ranks.encode_batch(texts)):
        assert ids.tolist() == library.encode_ordinary(text)
        assert ranks.decode(ids) == text.encode()


@pytest.mark.parametrize("length", [1, 2, 15, 16, 127, 128, 129, 130, 1000, 4000])
def test_long_matches(library, length):
    rng = random.Random(length)
    for letters in ("ab", "abcdefghijklm", "éñü日"):
        text = "".join(rng.choice(letters) for _ in range(length))
        assert bytepairs.load(RANKS, PATTERN).encode_batch([text])[0].tolist() == library.encode_ordinary(text)


def test_pairs_are_found_in_the_table_and_others_are_not():
    rng = np.random.default_rng(5)
    pairs = np.unique(rng.integers(0, 400, (3000, 2)), axis=0).astype(np.int32)
    table = bytepairs.PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs), dtype=np.int32))
    a, b = (x.ravel().astype(np.int32) for x in np.meshgrid(np.arange(-1, 400), np.arange(-1, 400)))
    want = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    assert table.find(a, b).tolist() == [want.get((x, y), np.iinfo(np.int32).max) for x, y in zip(a.tolist(), b.tolist())]


def test_spans_cut_where_no_match_reaches_across(library):
    rng, ranks = random.Random(3), bytepairs.load(RANKS, PATTERN)
    for _ in range(300):
        text = "".join(rng.choice(["a", " b", "  ", "\n", " \n ", "c1", "!?", "　"]) for _ in range(rng.randrange(0, 60)))
        cut = list(bytepairs.spans(text, rng.randrange(1, 20)))
        assert "".join(cut) == text
        assert [i for s in cut for i in ranks.encode_batch([s])[0].tolist()] == library.encode_ordinary(text)


def test_documents_and_odd_rows(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "one"), (-3, "one"), (None, "null id"), (-4, "wörd " * 500_000), (-5, "x" * 30_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string")).withColumns({"n_tokens": F.lit("clash"), "__row": F.lit(1)})
    out = bytepairs.encode(docs, RANKS, PATTERN, with_ids=True).select("__row.*", F.col("n_tokens").alias("n"), "ids", "ids_sha256", "decoded_sha256").collect()
    assert len(out) == 207 and all(r["n_tokens"] == "clash" and r["__row"] == 1 for r in out)
    for r in out:
        want = library.encode_ordinary(r["text"] or "")
        assert r["ids"] == want and r["n"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bytepairs.encode(docs.filter("false"), RANKS, PATTERN).count() == 0


def test_decoding_refuses_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [64, 65]), (2, []), (3, None)], "k int, ids array<int>").withColumn("decoded", F.lit("clash"))
    out = {r["k"]: bytes(r["decoded"]) for r in bytepairs.decode(rows, RANKS, PATTERN).collect()}
    assert out == {1: bytepairs.load(RANKS, PATTERN).decode(np.array([64, 65])), 2: b"", 3: b""}
    for bad in (-1, 1 << 20):
        with pytest.raises(ValueError):
            bytepairs.load(RANKS, PATTERN).decode(np.array([bad]))


# --- op12 ---------------------------------------------------------------------

def _cheapest(rows):
    """(cost, letters, result) by a search in the order of (cost, letters). Rows: (role, text, must go, truncated)."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, letters, at, due, out = heapq.heappop(heap)
        if (at, due) in seen:
            continue
        seen.add((at, due))
        if at == len(rows) and due in (0, 3):
            return cost, letters, "\n".join(out)
        moves = {0: "su", 1: "u", 2: "a", 3: "u"}[due]
        then = {"s": 1, "u": 2, "a": 3}
        for initial, role in (("u", "user"), ("a", "assistant")):
            if initial in moves:
                heapq.heappush(heap, (cost + 5, letters + "I", at, then[initial], (*out, f"{role}:")))
        if at == len(rows):
            continue
        role, text, gone, cut = rows[at]
        heapq.heappush(heap, (cost + 2, letters + "D", at + 1, due, out))
        if gone:
            continue
        if role[:1] and role[:1] in moves:
            heapq.heappush(heap, (cost + 5 * cut, letters + "K", at + 1, then[role[:1]], (*out, f"{role}:{text}")))
        for initial, new in (("u", "user"), ("a", "assistant")):
            if initial in moves:
                heapq.heappush(heap, (cost + 1 + 5 * cut, letters + "R", at + 1, then[initial], (*out, f"{new}:{text}")))
    raise AssertionError


def _repaired(rows):
    """What one conversation (turn, role, text) comes to."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, counts, told = set(), Counter(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        told.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    cost, letters, result = _cheapest(told)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": counts["blank"], "duplicate": counts["duplicate"], "truncated": counts["truncated"],
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost, "audit": letters, "repaired_sha256": hashlib.sha256(result.encode()).hexdigest(),
    }


def _damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: _repaired(rows) for conv, rows in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_weights_give_the_cheapest_first_edits(seed):
    rng = random.Random(seed)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), "t", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(0, 14))]
        signs = [(r[:1] if r[:1] in ("s", "u", "a") else "x") + ("d" if gone else "t" if cut else "g") for r, _, gone, cut in rows]
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(0, 4)))
        parts = [signs[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        cost, told = repair.solve([repair.run_matrix("".join(p)) for p in parts])
        assert (cost, "".join(letters for _, letters in told)) == _cheapest(rows)[:2]
        at, out = 0, []
        for (due, letters), part in zip(told, [*parts, []]):
            out += repair.lines(due, letters, [{"role": r[0], "text": r[1]} for r in rows[at : at + len(part)]])
            at += len(part)
        assert "\n".join(out) == _cheapest(rows)[2]


def test_repair_of_given_conversations(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = _damage([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    got = {r["conv_id"]: r.asDict() for r in queries.op12_repair(spark, "/root/testdata/sf0.01").collect()}
    assert got == {c: {"conv_id": c} | w for c, w in want.items()}


def test_repair_of_odd_and_long_conversations(spark, monkeypatch, tmp_path):
    rng, big = random.Random(8), 1 << 62
    say = lambda: rng.choice(["Yes.", "No", "", " \n", "Why?", "é!", "a\nb."])
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice([say(), None])) for c in [*range(60), None] for _ in range(rng.randrange(1, 12))]
    rows += [(100, t, rng.choice(["user", "assistant"]), say() + str(t % 40)) for t in range(900)] + [(100, 7, "user", "again.")] * 300
    rows += [(101, -big, "user", "Far."), (101, big, "assistant", "Farther."), (102, 0, "user", "x" * 100_000 + "."), (103, None, "user", "same"), (103, None, "user", "same")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"conv": F.lit(1), "place": F.lit("x"), "copies_": F.lit(2)})
    path = str(tmp_path / "conversations.parquet")
    table.repartition(3).write.parquet(path)
    got = {r["conv_id"]: r.asDict() for r in queries.op12_repair(spark, str(tmp_path)).collect()}
    want = _damage(rows)
    assert got.keys() == want.keys()
    for c, w in want.items():
        assert got[c] == {"conv_id": c} | w | {"gaps": min(w["gaps"], (1 << 63) - 1)}
    empty = repair.repair(table.filter("false"))
    assert empty.count() == 0


def test_conversation_that_lost_all_its_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a.", 0), (1, 1, "user", "b.", 0), (2, 0, "user", "a.", 1)], "conv_id int, turn int, role string, text string, copies int")
    got = {r["conv_id"]: r for r in repair.repair(rows, copies=F.col("copies")).collect()}
    assert got[1]["audit"] == "" and got[1]["repaired"] == "" and got[1]["cost"] == got[1]["gaps"] == 0
    assert got[2]["audit"] == "D" and got[2]["cost"] == 2


# --- op11 ---------------------------------------------------------------------

def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def _variants(docs):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    stems = defaultdict(set)  # two near words share a form that lost a letter, or one is such a form of the other
    for w in words:
        for i in range(len(w)):
            stems[w[:i] + w[i + 1 :]].add(w)
    near = {w: {o for i in range(len(w)) for o in stems[w[:i] + w[i + 1 :]]} | {w[:i] + w[i + 1 :] for i in range(len(w)) if w[:i] + w[i + 1 :] in words} | stems[w] for w in words}
    near = {w: {o for o in os if _near(w, o)} for w, os in near.items()}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def _got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("crowd, symbols", [(512, None), (1, None), (512, 2), (3, 2)])
def test_variants_of_given_documents(spark, monkeypatch, crowd, symbols):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    if symbols:
        monkeypatch.setattr(spelling, "n_symbols", lambda words: symbols)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = _variants([tuple(r) for r in docs.collect()])
    assert len(want) > 500 and any(w[0] for w in want.values())
    assert _got(spelling.variants(docs)) == want


def test_variants_of_odd_rows(spark):
    chain = [("abcdefgh", 1000), ("abcdefg", 100), ("abcdefx", 10), ("bbcdefx", 2), ("àbcdefgh", 7), ("ÀBCDEFGH", 3), ("×÷×÷×÷×", 2), ("once__", 1), ("aaaaaaa", 4), ("aaaaaaaa", 4)]
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)] + [(50, None), (51, ""), (None, "Ünïcodé Ünïcodé wordsss wordsss"), (52, "z" * 3000 + " " + "z" * 2999), (53, "z" * 3000 + " " + "z" * 2999)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit("clash"), "n": F.lit(5)})
    got = _got(spelling.variants(docs))
    assert got == _variants(rows)
    assert spelling.variants(docs.filter("false")).count() == 0


def test_long_texts_go_in_spans():
    text = "Wörter in a long text, " * 60_000
    assert Counter(spelling.runs_of(text)) == Counter(re.findall("[A-Za-zÀ-ÿ]{7,}", text)) == {}
    text = "Wörterbuch in a long text, " * 60_000
    assert Counter(spelling.runs_of(text)) == {"Wörterbuch": 60_000}


@pytest.mark.parametrize("cells", [1 << 21, 12])
def test_neighbourhoods_are_full(monkeypatch, cells):
    monkeypatch.setattr(spelling, "_CELLS", cells)
    rng = random.Random(cells)
    for _ in range(60):
        length, k = rng.randrange(2, 9), rng.randrange(2, 6)
        rows = [tuple(rng.randrange(k) for _ in range(length)) for _ in range(3)]
        got = defaultdict(list)
        for row, h in spelling.neighbourhood(np.array(rows), k):
            for r, x in zip(row.tolist(), h.tolist()):
                got[r].append(x)
        for i, r in enumerate(rows):
            want = {r} | {r[:j] + r[j + 1 :] for j in range(length)} | {r[:j] + (c,) + r[j + 1 :] for j in range(length) for c in range(k)}
            want |= {r[:j] + (c,) + r[j:] for j in range(length + 1) for c in range(k)}
            assert sorted(got[i]) == sorted(int(spelling.reduced(np.array([w]))[0]) for w in want)


# --- the pipeline's near copies ---------------------------------------------------

def test_near_copies_of_tables_with_odd_names_and_ids(spark):
    import corpus_pipeline

    top, low = (1 << 63) - 1, -(1 << 63)
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(top, one, "x"), (top, two, "y"), (top, one, "w"), (low, one + " more", "z"), (3, "short", "s"), (4, None, "n"), (None, one, "free")]
    clash = ["__digest", "__node", "digest", "node", "doc", "id", "others"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit(f"own {c}") for c in clash})
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    kept = out.collect()
    assert all(r[c] == f"own {c}" for r in kept for c in clash)
    assert sorted((str(r["doc_id"]), r["source"]) for r in kept) == sorted([(str(low), "z"), (str(top), "y"), ("3", "s"), ("4", "n"), ("None", "free")])
    same = docs.filter("text = '" + one + "' AND doc_id IS NOT NULL")
    assert [r["source"] for r in corpus_pipeline.drop_near_duplicates(spark, same, "").collect()] == ["w"]  # the first by its other columns
