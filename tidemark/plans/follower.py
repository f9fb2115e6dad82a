"""Finite catch-up passes: authorize, capture a target, apply bounded pages, recheck.

Sources and stores are ports: anything with ``head``, ``page`` (and ``open_page``), ``load``
and ``apply``. Access is checked again before every action.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import functions as F

from tidemark.schema import HEAD_VERSION, Limits, PageRequest, Refusal, Scope, SourceHead


class Authorizer(Protocol):
    def authorize(self, scope: Scope) -> None: ...


class Source(Protocol):
    def head(self, scope: Scope) -> SourceHead: ...

    def page(self, request: PageRequest) -> Any: ...


class Store(Protocol):
    def load(self, scope: Scope) -> int | None: ...

    def apply(self, scope: Scope, expected: int, plan: Any) -> Any: ...


@dataclass(frozen=True)
class Capabilities:
    """What this consumer understands; ``known`` bounds what it may declare."""

    reader: int = 0
    writer: int = 0
    known_reader: int = 0
    known_writer: int = 0

    def __post_init__(self) -> None:
        if self.reader & ~self.known_reader or self.writer & ~self.known_writer:
            raise Refusal("InvalidSupport")

    def check_reader(self, head: SourceHead) -> None:
        if head.version != HEAD_VERSION:
            raise Refusal("UnsupportedVersion")
        if head.reader_required & ~self.reader:
            raise Refusal("MissingReader")

    def check_writer(self, head: SourceHead) -> None:
        self.check_reader(head)
        if head.writer_required & ~self.writer:
            raise Refusal("MissingWriter")


@dataclass
class Pass:
    """A finite pass to a captured target."""

    scope: Scope
    position: int
    target: int

    @property
    def complete(self) -> bool:
        return self.position >= self.target


def _admit(scope: Scope, head: SourceHead, position: int) -> Pass:
    if head.scope != scope:
        raise Refusal("WrongScope")
    if head.position < position:
        raise Refusal("SourceBehindCheckpoint")
    return Pass(scope, position, head.position)


def begin_pass(scope: Scope, access: Authorizer, source: Source, store: Store, support: Capabilities | None = None) -> Pass:
    """Authorize, load the checkpoint, capture the head."""
    access.authorize(scope)
    position = store.load(scope) or 0
    head = source.head(scope)
    if support is not None:
        support.check_reader(head)
    return _admit(scope, head, position)


def begin_pass_with_page(scope: Scope, limits: Limits, access: Authorizer, source: Any, store: Store) -> Pass:
    """Head and first page come from one read; a page is applied at once."""
    access.authorize(scope)
    position = store.load(scope) or 0
    target, page = source.open_page(scope, position, limits)
    check_open_page(PageRequest(scope, position, target, limits), page)
    going = Pass(scope, position, target)
    if page is not None:
        going.position = _apply(going, page, store)
    return going


def check_page(request: PageRequest, page: Any) -> None:
    """Refuse a page that is not what was asked for: dense positions after the checkpoint up to the target at most, distinct ids, budgets."""
    limits = request.limits
    if isinstance(page, list):
        sizes, positions, ids = [len(r.payload) for r in page], [r.position for r in page], {r.record_id for r in page}
        n, lo, hi, distinct, total, largest = len(page), min(positions, default=None), max(positions, default=None), len(ids), sum(sizes), max(sizes, default=0)
        dense = positions == list(range(request.after + 1, request.after + n + 1))
    else:
        size = F.octet_length("payload")
        row = page.agg(
            F.count("*"), F.min("position"), F.max("position"), F.count_distinct("record_id"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0)), F.count_distinct("position"),
        ).first()
        n, lo, hi, distinct, total, largest, places = row
        dense = n > 0 and lo == request.after + 1 and hi == request.after + n and places == n
    if not n:
        raise Refusal("EmptyPage")
    if distinct != n:
        raise Refusal("WrongRecord")
    if largest > limits.record_bytes:
        raise Refusal("OversizedRecord")
    if n > limits.records or total > limits.total_bytes:
        raise Refusal("BoundsExceeded")
    if not dense or hi > request.target:
        raise Refusal("Noncontiguous")


def check_open_page(request: PageRequest, page: Any) -> None:
    """An open page's head is not behind the checkpoint, and it comes without records exactly if there is nothing new."""
    if request.target < request.after:
        raise Refusal("SourceBehindCheckpoint")
    if (page is None) != (request.target == request.after):
        raise Refusal("EmptyPage" if page is None else "Noncontiguous")
    if page is not None:
        check_page(request, page)


def _last(page: Any) -> int:
    if isinstance(page, list):
        return page[-1].position
    return page.agg(F.max("position")).first()[0]


def _apply(going: Pass, page: Any, store: Store) -> int:
    last = _last(page)
    saved = store.apply(going.scope, going.position, page)
    if isinstance(saved, int) and saved != last:
        raise Refusal("Uncertain", "the store saved another position than was planned")
    return last


class StepGate:
    """One page step that can be cancelled up to the moment it commits; exactly one side wins."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._state = "open"

    def _take(self, state: str) -> bool:
        with self._lock:
            if self._state != "open":
                return self._state == state
            self._state = state
            return True

    def cancel(self) -> bool:
        """True if the step will not commit."""
        return self._take("cancelled")

    def commit(self) -> bool:
        """True if the step may commit; asked once by the step."""
        return self._take("committed")


def step(going: Pass, limits: Limits, access: Authorizer, source: Source, store: Store, gate: StepGate | None = None) -> bool:
    """One page; True once the target is reached, or if the gate was cancelled with nothing applied."""
    if going.complete:
        return True
    access.authorize(going.scope)
    request = PageRequest(going.scope, going.position, going.target, limits)
    page = source.page(request)
    check_page(request, page)
    if gate is not None and not gate.commit():
        return False
    going.position = _apply(going, page, store)
    return going.complete


def finish_pass(going: Pass, limits: Limits, access: Authorizer, source: Source, store: Store) -> Pass:
    while not step(going, limits, access, source, store):
        pass
    return going


def catch_up(scope: Scope, limits: Limits, access: Authorizer, source: Source, store: Store) -> int:
    """Passes until a recheck finds the captured head reached."""
    while not (going := begin_pass(scope, access, source, store)).complete:
        finish_pass(going, limits, access, source, store)
    return going.position
