"""Retention: expiring pins, cutoffs, logical floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import MAX_PINS, Refusal


def live_pins(pins: DataFrame, now_ms: int | Column) -> DataFrame:
    """Pins that expire strictly after now."""
    return pins.filter(F.col("expires_at_ms") > now_ms)


def window_refusal(head: Column, floor: Column, preferred: Column, forced: Column) -> Column:
    return F.when(floor > head, "FloorAboveHead").when(preferred > head, "PreferredAboveHead").when(forced > head, "ForcedAboveHead")


def cutoff(preferred: Column, floor: Column, forced: Column, held: Column) -> Column:
    """The preferred cutoff yields to the least held position, never below the floor or a forced one."""
    return F.greatest(F.least(preferred, F.coalesce(held, preferred)), floor, F.coalesce(forced, floor))


def cutoffs(windows: DataFrame, pins: DataFrame, keys: list[str], now_ms: int) -> DataFrame:
    """``windows`` (keys, head, floor, preferred, forced) with ``cutoff`` and ``refusal``, from the live pins of the same scope.

    Pins are cut to one minimum for each scope before they meet the windows.
    """
    held = live_pins(pins, now_ms).groupBy(*keys).agg(F.min("completed").alias("__held"), F.max("completed").alias("__top"))
    rows = windows.join(held, keys, "left")
    refusal = F.coalesce(
        window_refusal(F.col("head"), F.col("floor"), F.col("preferred"), F.col("forced")),
        F.when(F.col("__top") > F.col("head"), "PinAboveHead"),
    )
    value = cutoff(F.col("preferred"), F.col("floor"), F.col("forced"), F.col("__held"))
    return rows.withColumn("refusal", refusal).withColumn("cutoff", F.when(F.col("refusal").isNull(), value)).drop("__held", "__top")


def readable(rows: DataFrame, position: str, floor: int) -> DataFrame:
    """Rows above the logical floor; rows below it stay stored for deduplication."""
    return rows.filter(F.col(position) > floor)


def advance(state: dict, now_ms: int) -> dict:
    """The state with its clock at now; the clock never goes back."""
    if now_ms < state.get("now_ms", 0):
        raise Refusal("ClockRegressed")
    return state | {"now_ms": now_ms}


def register(state: dict, holder: str, completed: int, now_ms: int, expires_at_ms: int) -> dict:
    """The state (``head``, ``floor``, ``pins``) with a new pin; a live one of the same holder stands in its way."""
    state = advance(state, now_ms)
    old = state.get("pins", {}).get(holder)
    if old and old["expires_at_ms"] > now_ms:
        raise Refusal("Exists")
    return _put(state, holder, completed, expires_at_ms, old["revision"] if old else 0)


def refresh(state: dict, receipt: dict, completed: int, now_ms: int, expires_at_ms: int) -> dict:
    """The state with a pin moved on, for who holds its last receipt."""
    state = advance(state, now_ms)
    old = state.get("pins", {}).get(receipt["holder"])
    if old != receipt:
        raise Refusal("Stale")
    if old["expires_at_ms"] <= now_ms:
        raise Refusal("Expired")
    if completed < old["completed"]:
        raise Refusal("ProgressRegressed")
    return _put(state, receipt["holder"], completed, expires_at_ms, old["revision"])


def _put(state: dict, holder: str, completed: int, expires_at_ms: int, revision: int) -> dict:
    if not state["floor"] <= completed <= state["head"]:
        raise Refusal("PinOutOfRange")
    if expires_at_ms <= state["now_ms"]:
        raise Refusal("Expired")
    pins = {k: v for k, v in state.get("pins", {}).items()}
    if holder not in pins and len(pins) >= MAX_PINS:
        raise Refusal("TooManyPins")
    pins[holder] = {"holder": holder, "completed": completed, "expires_at_ms": expires_at_ms, "revision": revision + 1}
    return state | {"pins": pins}


def held_cutoff(state: dict, preferred: int, forced: int | None, now_ms: int) -> int:
    """The cutoff of this moment: the preferred one yields to live pins, never below the floor or a forced one."""
    for name, value in (("FloorAboveHead", state["floor"]), ("PreferredAboveHead", preferred), ("ForcedAboveHead", forced or 0)):
        if value > state["head"]:
            raise Refusal(name)
    held = [p["completed"] for p in state.get("pins", {}).values() if p["expires_at_ms"] > now_ms]
    if any(c > state["head"] for c in held):
        raise Refusal("PinAboveHead")
    return max(min([preferred, *held]), state["floor"], forced if forced is not None else state["floor"])


class PinLedger:
    """Pins of one source in memory, by the same rules as those that tables keep."""

    def __init__(self) -> None:
        self._state: dict = {"head": 0, "floor": 0, "pins": {}}

    @property
    def floor(self) -> int:
        return self._state["floor"]

    @floor.setter
    def floor(self, value: int) -> None:
        self._state = self._state | {"floor": value}

    def register(self, holder: str, completed: int, now_ms: int, expires_at_ms: int, head: int) -> dict:
        self._state = register(self._state | {"head": head}, holder, completed, now_ms, expires_at_ms)
        return dict(self._state["pins"][holder])

    def refresh(self, receipt: dict, completed: int, now_ms: int, expires_at_ms: int, head: int) -> dict:
        self._state = refresh(self._state | {"head": head}, receipt, completed, now_ms, expires_at_ms)
        return dict(self._state["pins"][receipt["holder"]])

    def receipt(self, holder: str) -> dict | None:
        found = self._state["pins"].get(holder)
        return dict(found) if found else None

    def prune(self, head: int, preferred: int, forced: int | None, now_ms: int) -> int:
        """Raise the logical floor to the cutoff of this moment."""
        state = advance(self._state | {"head": head}, now_ms)
        self._state = state | {"floor": held_cutoff(state, preferred, forced, now_ms)}
        return self.floor
