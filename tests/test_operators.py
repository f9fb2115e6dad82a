import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import artifacts, catalogue, history, ordering, projections, records, retention, validate
from tidemark.schema import Limits, Refusal, Scope


def _table(spark, sizes):
    return records.Positioned(spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "raw bigint, size bigint"), "raw", 1)


@pytest.mark.parametrize("sizes, limits, want", [
    ([4, 4, 4], Limits(2, 8, 8), [1, 2]),
    ([4, 4, 4], Limits(9, 8, 8), [1, 2]),
    ([4, 4, 4], Limits(9, 7, 8), [1]),
    ([4, 9, 1], Limits(9, 99, 8), [1]),
    ([9], Limits(9, 99, 8), []),
    ([0, 0], Limits(9, 1, 1), [1, 2]),
])
def test_page_budget(spark, sizes, limits, want):
    rows = records.page(_table(spark, sizes), 0, len(sizes), limits, F.col("size"))
    assert [r["position"] for r in rows.orderBy("position").collect()] == want


def test_page_refusals(spark):
    t = _table(spark, [4, 9])
    ask = lambda *a, **k: records.page_refusal(t, *a, F.col("size"), **k).first()[0]
    assert ask(0, 3, Limits(1, 9, 9)) == "InvalidRange"
    assert ask(0, 2, Limits(1, 9, 9), floor=1) == "Pruned"
    assert ask(1, 2, Limits(1, 99, 8)) == "OversizedRecord"
    assert ask(0, 2, Limits(1, 9, 9)) is None
    with pytest.raises(Refusal):
        records.page(t, 2, 2, Limits(1, 1, 1), F.col("size"))
    with pytest.raises(Refusal):
        Limits(0, 1, 1)


def test_greedy_pages_follow_a_loop(spark):
    rng = random.Random(3)
    sizes = [rng.choice([1, 5, 20, 90, 150]) for _ in range(400)]
    limits = Limits(7, 120, 120)
    want, i = [], 0
    while i < len(sizes):
        j = i + 1
        while j < len(sizes) and j - i < limits.records and sum(sizes[i : j + 1]) <= limits.total_bytes:
            j += 1
        want.append((len(want) + 1, i + 1, j, j - i, sum(sizes[i:j])))
        i = j
    rows = _table(spark, sizes).all().select("position", "size")
    for bucket in (8, 64, 4096):
        got = records.greedy_pages(rows, limits, bucket).select("page", "first_position", "last_position", "records", "bytes")
        assert sorted(map(tuple, got.collect())) == want


def _simulate(log):
    state, head, told = {}, 0, []
    for seq, key, is_del, payload in log:
        e = state.get(key)
        if e and e["deleted"]:
            told.append("fenced")
        elif is_del and e is None:
            told.append("missing")
        elif not is_del and e and e["payload"] == payload:
            told.append("quiet")
        else:
            head += 1
            told.append("accepted")
            state[key] = {"creation": e["creation"] if e else head, "revision": head, "deleted": is_del, "payload": None if is_del else payload}
    return state, told


@pytest.mark.parametrize("width", [3, 17, 1 << 16])
def test_fold_follows_a_sequential_log(spark, width):
    rng = random.Random(width)
    keys = ["hot"] * 6 + list("abcdef")
    log = [(i, rng.choice(keys), rng.random() < 0.06, rng.choice(["x", "y", ""])) for i in range(300)]
    state, told = _simulate(log)
    df = spark.createDataFrame(log, "seq bigint, entry_id string, is_del boolean, payload string")
    assert [r[0] for r in catalogue.outcomes(df, width).orderBy("seq").select("outcome").collect()] == told
    rows = {r["entry_id"]: r.asDict() for r in catalogue.current(catalogue.accepted(df, width)).collect()}
    assert {k: {n: rows[k][n] for n in v} for k, v in state.items()} == state and len(rows) == len(state)


def test_fold_of_nothing(spark):
    df = spark.createDataFrame([], "seq bigint, entry_id string, is_del boolean, payload string")
    assert catalogue.current(catalogue.accepted(df)).count() == 0


def test_rank_and_last_before(spark):
    df = spark.createDataFrame([(i * 3, f"k{i % 2}", i if i % 5 else None) for i in range(100)], "o bigint, k string, v bigint")
    assert [r["n"] for r in ordering.with_rank(df, "o", "n", 16).orderBy("o").collect()] == list(range(1, 101))
    seen = {}
    for r in ordering.last_before(df, "k", "o", F.col("v"), "prev", 16).orderBy("o").collect():
        assert r["prev"] == seen.get(r["k"])
        if r["v"] is not None:
            seen[r["k"]] = r["v"]


def test_collection_is_strict_and_bounded(spark):
    e = spark.createDataFrame([("a", 1, 5, True, None, True), ("b", 2, 6, True, None, True), ("c", 3, 3, False, "x", True)], "entry_id string, creation bigint, revision bigint, deleted boolean, payload string, visible boolean")
    hidden = catalogue.collect(e, 6, 0, 9)
    assert {r["entry_id"] for r in hidden.filter("NOT visible").collect()} == {"a"}
    for bad in ((5, 6, 9), (10, 0, 9)):
        with pytest.raises(Refusal):
            catalogue.collect(e, *bad)
    entries, proofs = catalogue.compact(hidden, e.filter("false").select("entry_id", "creation", "revision"), 6)
    assert [r["entry_id"] for r in proofs.collect()] == ["a"] and entries.count() == 2


@pytest.mark.parametrize("before, after, want", [
    ((1, 5, False), (2, 6, False), "WrongPayload"), ((1, 5, False), (1, 4, False), "WrongPayload"),
    ((1, 5, True), (1, 6, False), "DeletionFence"), ((1, 5, False), (1, 5, True), "WrongPayload"), ((1, 5, False), (1, 6, True), None),
])
def test_transitions(spark, before, after, want):
    kind = "creation bigint, revision bigint, deleted boolean".replace(" bigint", ":bigint").replace(" boolean", ":boolean")
    df = spark.createDataFrame([(before, after)], f"b struct<{kind}>, a struct<{kind}>")
    assert df.select(catalogue.transition_refusal("b", "a")).first()[0] == want


@pytest.mark.parametrize("now, forced, want", [(99, None, 40), (99, 70, 70), (100, None, 60), (120, None, 90)])
def test_cutoffs(spark, now, forced, want):
    pins = spark.createDataFrame([("r", "phone", 40, 100), ("r", "backup", 60, 120), ("other", "x", 1, 999)], "resource string, holder string, completed bigint, expires_at_ms bigint")
    w = spark.createDataFrame([("r", 100, 10, 90, forced)], "resource string, head bigint, floor bigint, preferred bigint, forced bigint")
    row = retention.cutoffs(w, pins, ["resource"], now).first()
    assert (row["cutoff"], row["refusal"]) == (want, None)
    ledger = retention.PinLedger()
    ledger.floor = 10
    ledger.register("phone", 40, 0, 100, 100)
    ledger.register("backup", 60, 0, 120, 100)
    assert ledger.prune(100, 90, forced, now) == want


def test_pin_ledger_refusals():
    ledger = retention.PinLedger()
    receipt = ledger.register("a", 5, 10, 20, 9)
    for call in (lambda: ledger.register("a", 5, 11, 30, 9), lambda: ledger.refresh(receipt, 4, 11, 30, 9), lambda: ledger.register("b", 10, 11, 30, 9), lambda: ledger.prune(9, 9, None, 3)):
        with pytest.raises(Refusal):
            call()
    assert ledger.refresh(receipt, 6, 12, 30, 9)["revision"] == 2
    with pytest.raises(Refusal):
        ledger.refresh(receipt, 7, 12, 30, 9)


def test_hydration_queue():
    q = history.HydrationQueue(3)
    for t in (21, 25, 40):
        q.request(t)
    with pytest.raises(Refusal):
        q.request(1)
    assert q.next_target(36) == 21 and q.resolve(21) == 3 and q.next_target(21) is None and q.waiters == 0


def test_history_progress():
    p = history.progress_after_tail(None, 1, 36, 40, 1)
    p = history.progress_after_older(p, 1, 31, 35, 1)
    assert p["lower_bound"] == 31
    for call in (lambda: history.progress_after_tail(p, 1, 40, 41, 1), lambda: history.progress_after_tail(p, 2, 30, 39, 1), lambda: history.progress_after_older(p, 2, 20, 30, 1), lambda: history.progress_after_tail(None, 1, 1, 1, 1, True)):
        with pytest.raises(Refusal):
            call()
    gone = history.progress_after_deletion(p)
    assert gone["deleted"] and gone["generation"] == 1
    with pytest.raises(Refusal):
        history.progress_after_tail(gone, 9, 1, 50, 1)


def test_artifacts(spark):
    data = {"a": b"x" * 10, "b": b"", "c": "é".encode() * 7}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "artifact_id string, payload binary")
    pieces = artifacts.chunks(df, 4)
    assert pieces.filter("artifact_id = 'b'").count() == 0
    whole = artifacts.verify(artifacts.identities(df), artifacts.assemble(pieces))
    assert all(r["verified"] for r in whole.collect())
    torn = artifacts.verify(artifacts.identities(df), artifacts.assemble(pieces.filter("NOT (artifact_id = 'a' AND offset = 4)")))
    assert {r["artifact_id"] for r in torn.filter("NOT verified").collect()} == {"a"}
    with pytest.raises(Refusal):
        artifacts.chunks(df, (64 << 10) + 1)


def test_masks_and_fields(spark):
    df = spark.createDataFrame([(0, "héllo"), (-1, ""), (1 << 62, "x" * 300)], "m bigint, t string")
    for r in df.select("m", C.bytes_to_mask(C.mask_to_bytes(F.col("m"))).alias("n"), "t", C.text_field(C.encode_field(F.col("t")), 0).alias("u")).collect():
        assert r["m"] == r["n"] and r["t"] == r["u"]


def test_ids(spark):
    rows = [("x" * 128, None), ("x" * 129, "InvalidId"), (" \t  ", "InvalidId"), ("é" * 64, None), ("é" * 65, "InvalidId")]
    for r in spark.createDataFrame(rows, "id string, want string").select(C.id_refusal(F.col("id")).alias("got"), "want").collect():
        assert r["got"] == r["want"]
    with pytest.raises(Refusal):
        Scope("r", "o", "s", "i", "", "e")


def test_task_board(spark):
    ops = [(1, "create", "t1", "alpha", None), (2, "create", "t2", "temporary", None), (3, "title", "t1", "updated", None), (4, "delete", "t2", None, None), (5, "complete", "t1", None, True), (6, "delete", "t9", None, None)]
    df = spark.createDataFrame(ops, "position bigint, op string, task string, title string, done boolean")
    assert [tuple(r) for r in projections.task_board(df).collect()] == [("t1", "updated", True)]
    assert [r["position"] for r in projections.task_violations(df).collect()] == [6]
    text = spark.createDataFrame([(1, 1, "<script>hello")], "s int, p int, t string")
    assert projections.transcript(text, "s", "p", "t").first()["text"] == "&lt;script&gt;hello"


def _pages(spark, rows, **request):
    r = {"after": 10, "target": 14, "max_records": 3, "max_bytes": 20, "max_record_bytes": 9} | request
    req = spark.createDataFrame([(1, *r.values())], "page int, " + ", ".join(f"{k} bigint" for k in r))
    df = spark.createDataFrame([(1, i + 1, *x) for i, x in enumerate(rows)], "page int, ordinal int, position bigint, record_id string, size bigint, same_scope boolean")
    return validate.pages(df, req).first()["refusal"]


@pytest.mark.parametrize("rows, request_, want", [
    ([(11, "a", 5, True), (12, "b", 5, True)], {}, None),
    ([], {}, "EmptyPage"),
    ([(11, "a", 5, True)], {"target": 10}, "InvalidRange"),
    ([(11, "a", 1, True), (12, "b", 1, True), (13, "c", 1, True), (14, "d", 1, True)], {}, "BoundsExceeded"),
    ([(11, "a", 5, True), (12, "a", 5, True)], {}, "WrongRecord"),
    ([(11, "a", 5, False)], {}, "WrongRecord"),
    ([(11, "a", 10, True)], {}, "OversizedRecord"),
    ([(11, "a", 9, True), (12, "b", 9, True), (13, "c", 9, True)], {}, "BoundsExceeded"),
    ([(12, "a", 5, True)], {}, "Noncontiguous"),
    ([(11, "a", 5, True), (12, "b", 5, True)], {"target": 11}, "Noncontiguous"),
    ([(12, "a", 10, True)], {}, "OversizedRecord"),
])
def test_page_rules_in_order(spark, rows, request_, want):
    assert _pages(spark, rows, **request_) == want


def test_history_and_manifest_rules(spark):
    req = spark.createDataFrame([(1, 1, 5, 6, 1, 3, 20, 9), (2, 1, 5, 7, 1, 3, 20, 9), (3, 1, 5, 6, 6, 3, 20, 9), (4, 0, 5, 6, 1, 3, 20, 9)], "page int, generation bigint, first bigint, last bigint, oldest bigint, max_records bigint, max_bytes bigint, max_record_bytes bigint")
    rows = spark.createDataFrame([(p, i, 4 + i, f"r{i}", 3, True) for p in (1, 2, 3, 4) for i in (1, 2)], "page int, ordinal int, position bigint, record_id string, size bigint, same_scope boolean")
    got = {r["page"]: r["refusal"] for r in validate.history_pages(rows, req).collect()}
    assert got == {1: None, 2: "InvalidBoundary", 3: "InvalidBoundary", 4: "InvalidRequest"}
    req = spark.createDataFrame([(p, 2, 9, 1, 1, "b", 2, more) for p, more in ((1, False), (2, False), (3, True), (4, False), (5, False))], "page int, completed bigint, boundary bigint, generation bigint, cursor_creation bigint, cursor_id string, max_entries int, has_more boolean")
    rows = spark.createDataFrame([(1, 1, "c", 1, 3), (1, 2, "a", 2, 4), (2, 1, "a", 1, 3), (4, 1, "x", 10, 11), (5, 1, "c", 3, 3), (5, 2, "c", 4, 4)], "page int, ordinal int, entry_id string, creation bigint, revision bigint")
    got = {r["page"]: r["refusal"] for r in validate.manifests(rows, req).collect()}
    assert got == {1: None, 2: "InvalidOrder", 3: "NoProgress", 4: "InvalidOrder", 5: "InvalidOrder"}


def test_refused_rows_take_no_position(spark):
    """Known, conflicting and new records in one batch, over several buckets of the order."""
    from tidemark.operators.records import append_plan

    incoming = spark.createDataFrame([(k * 40_000, f"r{k}", f"p{k}".encode()) for k in range(1, 9)] + [(None, "r9", b"x"), (400_000, "r9", b"y"), (None, "r1", b"z")], "seq bigint, record_id string, payload binary")
    saved = spark.createDataFrame([("r2", b"p2"), ("r3", b"other")], "record_id string, payload binary")
    got = {r["record_id"]: (r["position"], r["refusal"]) for r in append_plan(incoming, saved, 100).collect()}
    bad = (None, "ConflictingRecord")
    assert got == {"r1": bad, "r3": bad, "r9": bad, "r4": (101, None), "r5": (102, None), "r6": (103, None), "r7": (104, None), "r8": (105, None)}
