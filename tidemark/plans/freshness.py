"""Freshness policy around local reads: when to check the source, when to wait, what is known."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from tidemark.plans.follower import Capabilities, Pass, begin_pass, step
from tidemark.schema import Limits, Refusal, Scope

#: Refusals after which a check is tried again, and those that ask for a reload.
RETRIED = ("Unverifiable", "Unavailable", "Failed")
RELOADED = ("Uncertain", "Stale")


@dataclass(frozen=True)
class Observed:
    """What is known beside a local value. Times are of the owner's clock."""

    scope: Scope
    clock_generation: int
    applied_at: float | None
    checked_at: float | None
    head: int | None
    position: int | None
    failed: bool
    pending: bool
    retry_at: float | None
    phase: str


class Freshness:
    """The one owner of checks, passes and retries for a scope.

    ``policy`` is "never", "always" or a time to live in seconds. ``jitter`` picks a delay up to
    its argument, the window; it is kept to the window's upper half. Windows double up to ``max_retry``.
    """

    def __init__(self, scope: Scope, policy: str | float, clock: Callable[[], float], jitter: Callable[[float], float], first_retry: float, max_retry: float, support: Capabilities | None = None):
        if not 0 < first_retry <= max_retry:
            raise Refusal("InvalidRetry")
        self.policy, self.clock, self.jitter, self.support = policy, clock, jitter, support
        self.first_retry, self.max_retry = first_retry, max_retry
        self.generation = 0
        self._begin(scope)

    def _begin(self, scope: Scope) -> None:
        self.scope = scope
        self.window = self.first_retry
        self.last_now = self.clock()
        self.applied_at = self.checked_at = self.retry_at = None
        self.head = self.position = None
        self.failed = self.pending = False
        self.phase = "idle"
        self._pass: Pass | None = None

    def _now(self) -> float:
        now = self.clock()
        if now < self.last_now:
            # Another clock: old times say nothing; a retry keeps what was left of its wait.
            self.generation += 1
            self.applied_at = self.checked_at = None
            if self.retry_at is not None:
                self.retry_at = now + max(0.0, self.retry_at - self.last_now)
        self.last_now = now
        return now

    def observed(self) -> Observed:
        self._now()
        pending = self.pending or self.phase == "recheck"
        return Observed(self.scope, self.generation, self.applied_at, self.checked_at, self.head, self.position, self.failed, pending, self.retry_at, self.phase)

    def request(self) -> None:
        """A wake hint: it asks for a check but ends no wait and no stop."""
        self.pending = True

    def resume(self) -> None:
        """The host has dealt with a stop or an unknown outcome."""
        if self.phase in ("reload_required", "stopped"):
            self._pass, self.phase = None, "idle"
        self.pending = True

    def reset_scope(self, scope: Scope) -> None:
        self.generation += 1
        self._begin(scope)

    def _ready(self, now: float) -> bool:
        if self.phase == "reload_required":
            raise Refusal("ReloadRequired")
        if self.phase == "stopped":
            raise Refusal("Stopped")
        return self.retry_at is None or now >= self.retry_at

    def _refused(self, refusal: Refusal) -> None:
        self.failed = True
        if refusal.code in RELOADED:
            self._pass = self.position = self.applied_at = None
            self.phase = "reload_required"
        elif refusal.code in RETRIED:
            delay = min(max(self.jitter(self.window), self.window / 2), self.window)
            self.retry_at = self._now() + delay
            self.window = min(self.window * 2, self.max_retry)
        else:
            self._pass, self.phase = None, "stopped"

    def _calm(self) -> None:
        self.retry_at, self.window = None, self.first_retry

    def drive(self, limits: Limits, access: Any, source: Any, store: Any) -> str:
        """At most one head check or one page: waiting, checked or applied."""
        if not self._ready(self._now()):
            return "waiting"
        try:
            if self.phase == "applying":
                going = self._pass
                before = going.position
                done = step(going, limits, access, source, store)
                self.position = going.position
                if going.position > before:
                    self.applied_at = self._now()
                self._calm()
                if done:  # a pass is always followed by a recheck, whatever the policy
                    self._pass, self.phase = None, "recheck"
                return "applied"
            if self.pending or self.phase == "recheck":
                going = begin_pass(self.scope, access, source, store, self.support)
                self.checked_at = self._now()
                self.head, self.position = going.target, going.position
                self.failed = self.pending = False
                self._calm()
                self._pass, self.phase = (None, "idle") if going.complete else (going, "applying")
                return "checked"
        except Refusal as refusal:
            self._refused(refusal)
            raise
        return "waiting"

    def read(self, fresh: bool, limits: Limits, access: Any, source: Any, store: Any, local: Callable[[Any, Scope], Any]) -> tuple[Any, Observed]:
        """A local value with what is known of its freshness. Only "always" asks the source first."""
        now = self._now()
        if fresh and self.policy == "always":
            self.pending = True
            if not self._ready(now) or self.phase == "applying":
                raise Refusal("Deferred")
            self.drive(limits, access, source, store)
        elif fresh and self.policy != "never":
            if self.failed or self.checked_at is None or now - self.checked_at > float(self.policy):
                self.pending = True
        return local(store, self.scope), self.observed()
