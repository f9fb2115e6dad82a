"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

Rows of a conversation, in order, are kept (0), given the role user or assistant (1), or deleted (2); turns without text may be put
in anywhere (5); a truncated row that stays costs 5 more; blank rows and rows whose role and text came earlier must go. The
initials of the roles that remain have to be ``(s?(ua)+)?``. Among the cheapest edits those count whose letters (Delete,
Insert, Keep, Rerole) come first in ASCII order.

One integer decides. The weight of a path has its cost in the high digits; below them stand, at fixed width, three bits for each edit
letter, the first letter highest, with zeros behind the last. An edge adds its cost and its letter at the next position, and the least
integer wins at each node (row, role that is due). Two paths to one node with one cost have consumed the same rows, so neither's letters
begin the other's, and the order of the integers is that of (cost, letters) whatever follows.

Rows are dealt by ranges of (conversation, turn), so a conversation that holds much of the table is spread. Runs of at most ``RUN``
rows become matrices of weights from each due role to each; the matrices of a conversation are joined as a tree, whose
weights concatenate by shifts, and tell every run where it begins and which letters are its own. The runs then write
their part of the result. Only these small rows, and at last the result itself, meet by conversation.

Nulls and edges: a null role or text counts as one space, so a null text is blank; null turns come first; rows of one turn are ordered by
role, then text; a null conversation is one conversation; conversations of no rows (``copies`` of 0 only), and of rows that must all
go, have an empty result; repeated rows after the first are duplicates; long texts are never cut; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import join_dealt
from tidemark.llm.runtime import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LETTERS = "DIKR"  # in ASCII order; 0 is no letter
ROLES = {"u": "user", "a": "assistant"}
#: What is due: anything at the start, user after system, assistant after user, user after assistant. Between initials, the moves.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
#: Rows of one matrix, and bytes of their texts after which it ends early.
RUN = 64
RUN_BYTES = 4 << 20
SPACES = " \t\n\x0b\x0c\r"
_MAX = (1 << 63) - 1

#: A weight (cost above the letters) and how many letters it has.
Weight = tuple[int, int]
#: Rows from each due role to each; None where no path leads. Second: how many letters have room below the cost.
Matrix = tuple[list[list[Weight | None]], int]


def _edge(w: Weight, letter: str, cost: int, room: int) -> Weight:
    digit = LETTERS.index(letter) + 1
    return w[0] + (cost << 3 * room) + (digit << 3 * (room - 1 - w[1])), w[1] + 1


def _put(nodes: list, at: int, w: Weight) -> None:
    if nodes[at] is None or w < nodes[at]:
        nodes[at] = w


def _inserted(nodes: list, room: int) -> list:
    """Nodes after up to two turns put in: a third would only come back to what was due."""
    out = list(nodes)
    for _ in range(2):
        before = list(out)
        for (due, role), then in MOVES.items():
            if role in ROLES and before[due] is not None:
                _put(out, then, _edge(before[due], "I", INSERT, room))
    return out


@lru_cache(maxsize=1 << 15)
def run_matrix(rows: str) -> Matrix:
    """The least weights of a run. Two characters a row: an initial ("x" for any other), and "d" (must go), "t" (truncated) or "g" (good)."""
    n = len(rows) // 2
    room = 3 * n + 2
    out = []
    for start in range(4):
        nodes: list = [None] * 4
        nodes[start] = (0, 0)
        for k in range(n):
            initial, kind = rows[2 * k], rows[2 * k + 1]
            nodes = _inserted(nodes, room)
            after: list = [None] * 4
            more = TRUNCATED if kind == "t" else 0
            for due, w in enumerate(nodes):
                if w is None:
                    continue
                _put(after, due, _edge(w, "D", DELETE, room))
                if kind == "d":
                    continue
                if (due, initial) in MOVES:
                    _put(after, MOVES[due, initial], _edge(w, "K", KEEP + more, room))
                for role in ROLES:
                    if (due, role) in MOVES:
                        _put(after, MOVES[due, role], _edge(w, "R", REROLE + more, room))
            nodes = after
        out.append(nodes)
    return out, room


def _last_matrix() -> Matrix:
    """Turns put in behind the last row."""
    return [_inserted([(0, 0) if k == start else None for k in range(4)], 2) for start in range(4)], 2


def _concat(a: Weight, a_room: int, b: Weight, b_room: int) -> Weight:
    """The weight of one path behind another: costs add up, letters follow letters."""
    cost_a, letters_a = a[0] >> 3 * a_room, a[0] & (1 << 3 * a_room) - 1
    cost_b, letters_b = b[0] >> 3 * b_room, b[0] & (1 << 3 * b_room) - 1
    digits = (letters_a << 3 * b_room) + (letters_b << 3 * (a_room - a[1]))
    return (cost_a + cost_b << 3 * (a_room + b_room)) + digits, a[1] + b[1]


def _tree(parts: list[Matrix], lo: int, hi: int) -> tuple:
    """(matrix, middle choices, left, right, lo) of parts lo to hi - 1."""
    if hi - lo == 1:
        return parts[lo], None, None, None, lo
    mid = (lo + hi) // 2
    left, right = _tree(parts, lo, mid), _tree(parts, mid, hi)
    (a, a_room), (b, b_room) = left[0], right[0]
    out, via = [[None] * 4 for _ in range(4)], [[0] * 4 for _ in range(4)]
    for i in range(4):
        for j in range(4):
            for k in range(4):
                if a[i][k] is not None and b[k][j] is not None:
                    w = _concat(a[i][k], a_room, b[k][j], b_room)
                    if out[i][j] is None or w < out[i][j]:
                        out[i][j], via[i][j] = w, k
    return (out, a_room + b_room), via, left, right, lo


def _spelled(w: Weight, room: int) -> str:
    return "".join(LETTERS[(w[0] >> 3 * (room - 1 - k) & 7) - 1] for k in range(w[1]))


def solve(parts: list[Matrix]) -> tuple[int, list[tuple[int, str]]]:
    """The least cost, and for each part, and for what is put in behind the last, what is due where it begins and its letters."""
    top = _tree([*parts, _last_matrix()], 0, len(parts) + 1)
    (weights, room) = top[0]
    end = min((e for e in ENDS if weights[0][e] is not None), key=lambda e: weights[0][e])
    told: list = [None] * (len(parts) + 1)
    todo = [(top, 0, end)]
    while todo:
        (matrix, via, left, right, at), i, j = todo.pop()
        if via is None:
            told[at] = (i, _spelled(matrix[0][i][j], matrix[1]))
        else:
            todo += [(left, i, via[i][j]), (right, via[i][j], j)]
    return weights[0][end][0] >> 3 * room, told


def lines(due: int, letters: str, rows: list[dict]) -> list[str]:
    """``role:text`` of what remains of a run."""
    out, at = [], 0
    for letter in letters:
        if letter == "D":
            at += 1
            continue
        if letter == "K":
            row, at = rows[at], at + 1
            role, text, initial = row["role"], row["text"], row["role"][:1]
        else:
            initial = "a" if due == 2 else "u"
            role, text = ROLES[initial], ""
            if letter == "R":
                text, at = rows[at]["text"], at + 1
        due = MOVES[due, initial]
        out.append(f"{role}:{text}")
    return out


# --- runs of rows ----------------------------------------------------------

_RUN_FIELDS = (
    "place bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
    "low bigint, high bigint, turns bigint, room int, weights array<struct<w:binary,n:int>>, rows array<struct<role:string,text:string>>"
)
_WEIGHTS = pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int32())]))
_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_RUN_ARROW = [
    ("place", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
    ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("room", pa.int32()), ("weights", _WEIGHTS), ("rows", _ROWS),
]
LEGAL = ("su", "ua", "au")


class _Runs:
    """Collects the rows of a partition, in order, into runs."""

    def __init__(self, part: int):
        self.place, self.made, self.key = part << 32, [], None
        self._open()

    def _open(self) -> None:
        self.n, self.bytes, self.signs, self.rows = 0, 0, [], []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.first = self.last = self.low = self.high = None
        self.turns = 0

    def close(self) -> None:
        if self.key is None:
            return
        matrix, room = run_matrix("".join(self.signs))
        weights = [None if w is None else {"w": w[0].to_bytes((w[0].bit_length() + 7) // 8, "big"), "n": w[1]} for row in matrix for w in row]
        self.made.append((self.key, {
            "place": self.place, **self.counts, "first": self.first, "last": self.last, "low": self.low, "high": self.high,
            "turns": self.turns, "room": room, "weights": weights, "rows": self.rows,
        }))
        self.place += 1
        self._open()

    def add(self, key: tuple, turn: int | None, role: str | None, text: str | None, fault: str, copies: int, again: bool) -> None:
        if key != self.key:
            self.close()
            self.key = key
        for k in range(copies):
            if self.n == RUN or self.bytes > RUN_BYTES:
                self.close()
            kind = fault if fault == "blank" else "duplicate" if again or k else fault
            if kind:
                self.counts[kind] += 1
            initial = role[:1]
            if self.n and self.last + initial not in LEGAL:
                self.counts["illegal"] += 1
            if not self.n:
                self.first = initial
            self.last = initial
            if turn is not None and turn != self.high:
                self.turns += 1
                self.low = turn if self.low is None else self.low
                self.high = turn
            goes = kind in ("blank", "duplicate")
            self.signs.append((initial if initial in ("s", "u", "a") else "x") + ("d" if goes else "t" if kind else "g"))
            self.rows.append({"role": role, "text": None if goes else text})
            self.bytes += 0 if goes else len(text)
            self.n += 1

    def take(self) -> tuple[list, list]:
        made, self.made = self.made, []
        return [k for k, _ in made], [r for _, r in made]


def _runs(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, typed = _Runs(TaskContext.get().partitionId()), pa.int64()

        def made() -> pa.RecordBatch:
            keys, told = runs.take()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], typed), *[pa.array([t[n] for t in told], a) for n, a in _RUN_ARROW]], names=["conv", *[n for n, _ in _RUN_ARROW]]
            )

        for batch in batches:
            typed = batch.column(0).type
            for conv, turn, role, text, fault, copies, again in zip(*[c.to_pylist() for c in batch.columns]):
                runs.add((conv,), turn, role, text, fault, copies, again)
                if len(runs.made) >= 256:
                    yield made()
        runs.close()
        if runs.made:
            yield made()

    return rows.mapInArrow(run, f"conv {kind}, {_RUN_FIELDS}")


# --- conversations ------------------------------------------------------------

_TOLD = "cid bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, tail string, steps array<struct<place:bigint,due:int,letters:string>>"
_STEPS = pa.list_(pa.struct([("place", pa.int64()), ("due", pa.int32()), ("letters", pa.string())]))


def _decided(runs: list[dict]) -> dict:
    """What the runs of a conversation, in order, come to together."""
    runs.sort(key=lambda r: r["place"])
    sums = {k: sum(r[k] for r in runs) for k in ("blank", "duplicate", "truncated", "illegal")}
    last = low = high = None
    turns = 0
    for r in runs:
        if r["first"] is not None:
            sums["illegal"] += last is not None and last + r["first"] not in LEGAL
            last = r["last"]
        if r["low"] is not None:
            turns += r["turns"] - (r["low"] == high)
            low, high = r["low"] if low is None else low, r["high"]
    parts = []
    for r in runs:
        flat = [w and (int.from_bytes(w["w"], "big"), w["n"]) for w in r["weights"]]
        parts.append(([flat[4 * i : 4 * i + 4] for i in range(4)], r["room"]))
    cost, told = solve(parts)
    steps = [{"place": r["place"], "due": due, "letters": letters} for r, (due, letters) in zip(runs, told)]
    return {
        "cid": runs[0]["place"], "gaps": 0 if low is None else min(high - low + 1 - turns, _MAX), **sums, "cost": cost,
        "audit": "".join(letters for _, letters in told), "tail": "\n".join(lines(*told[-1], [])) if told[-1][1] else None, "steps": steps,
    }


def _decide(conversations: DataFrame) -> DataFrame:
    kind = conversations.schema["conv"].dataType.simpleString()
    fields = [("cid", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("tail", pa.string()), ("steps", _STEPS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [_decided(runs) for runs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([t[n] for t in told], a) for n, a in fields]], names=["conv", *[n for n, _ in fields]])

    return conversations.mapInArrow(run, f"conv {kind}, {_TOLD}")


def _write(steps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.column(n) for n in ("due", "letters", "rows")]
            pieces = ["\n".join(x) if (x := lines(*row)) else None for row in zip(*[c.to_pylist() for c in at])]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("place"), pa.array(pieces, pa.string())], names=["cid", "place", "piece"])

    return steps.mapInArrow(run, "cid bigint, place bigint, piece string")


def repair(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None
) -> DataFrame:
    """A row for each conversation: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired``.

    ``copies`` tells how often a row counts; conversations of rows that count 0 times are in the result, too. ``repaired`` has the lines
    ``role:text``. ``gaps`` that do not fit a long are the largest long.
    """
    count = F.lit(1) if copies is None else copies
    there = count > 0
    rows = turns.select(
        F.col(f"`{conversation}`").alias("conv"),
        F.when(there, F.col(f"`{turn}`").cast("bigint")).alias("turn"),
        F.when(there, F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" "))).otherwise("").alias("role"),
        F.when(there, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" "))).otherwise("").alias("text"),
        count.cast("bigint").alias("copies"),
    )
    # Repeated rows first become one with a count; the key tells conversation, role and text apart without ambiguity.
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    spelled = F.coalesce(F.col("conv").cast("string"), F.lit("-"))
    same = F.concat_ws("\x00", F.length(spelled).cast("string"), spelled, F.col("conv").isNull().cast("string"), F.length("role").cast("string"), "role", "text")
    rows = materialize(rows.withColumn("same", F.sha2(same, 256)), "turns")
    counted = rows.filter("copies > 0")
    firsts = counted.groupBy("same").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = join_dealt(rows, firsts, "same", "turn", rows.count(), how="left")
    again = F.col("first").isNotNull() & ~F.col("first")["turn"].eqNullSafe(F.col("turn"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    rows = rows.withColumns({"fault": fault, "again": again, "head": F.left("text", F.lit(64))})
    dealt = rows.repartitionByRange("conv", "turn", "role", "head").sortWithinPartitions("conv", "turn", "role", "head", "text")
    runs = materialize(_runs(dealt.select("conv", "turn", "role", "text", "fault", "copies", "again")), "runs")
    told = materialize(_decide(runs.groupBy("conv").agg(F.collect_list(F.struct(*[c for c in runs.columns if c not in ("conv", "rows")])).alias("runs"))), "told")
    steps = told.select("cid", F.inline("steps"))
    pieces = _write(steps.join(runs.select("place", "rows"), "place").select("cid", "place", "due", "letters", "rows"))
    bodies = pieces.groupBy("cid").agg(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("place", "piece")))).alias("pieces"))
    body = F.array_join(F.concat(F.transform("pieces", lambda p: p["piece"]), F.array_compact(F.array("tail"))), "\n")
    return told.join(bodies, "cid").select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", body.alias("repaired"),
    )
