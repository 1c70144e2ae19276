"""Debounced sweeps with timers, as a stateful stream.

A project's activity asks for a sweep of its stale claims; a burst gives one. A sweep
takes ``cap`` candidates at most. What is left over comes back after half the interval
by a timer, whether or not there is any activity, and again until nothing is left. The
state of a project is its last stamp and what is left, and goes by the same timer once
the stamp is so old that it holds nothing back.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SWEEPS = "project string, at_ms long, archived long, overflow long, cause string"
#: What Spark keeps such state in.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Debounced(NamedTuple):
    """A project's last stamp in milliseconds, whether a sweep here set it, and the candidates left over."""

    stamp: int
    own: bool
    left: int


def _swept(at: int, pending: int, interval: int, cap: int, cause: str) -> tuple[Debounced, tuple]:
    archived = pending if cap < 1 else min(pending, cap)
    left = pending - archived
    return Debounced(at - interval // 2 if left else at, True, left), (at, archived, left, cause)


def drained(state: Debounced | None, now: int, interval: int, cap: int) -> tuple[Debounced | None, list[tuple]]:
    """The sweeps that a project's timer gives up to ``now``; a stamp that holds nothing back any more is no state."""
    out = []
    while state and state.stamp + interval <= now:
        if not state.left:
            return None, out
        state, sweep = _swept(state.stamp + interval, state.left, interval, cap, "timer")
        out.append(sweep)
    return state, out


def stepped(state: Debounced | None, at: int, pending: int | None, stamp: int | None, interval: int, cap: int) -> tuple[Debounced | None, list[tuple]]:
    """State and sweeps after one row: an activity that counts ``pending`` candidates, or a ``stamp`` from elsewhere."""
    state, out = drained(state, at, interval, cap)
    if stamp is not None:
        # the later stamp holds; one from the future holds nothing back, as the clock that set it was wrong
        if stamp <= at and (state is None or (not state.left and stamp > state.stamp)):
            state = Debounced(stamp, False, 0)
        return state, out
    if state is None or at - state.stamp >= interval:
        state, sweep = _swept(at, pending or 0, interval, cap, "activity")
        return state, [*out, sweep]
    # within the interval: no sweep, but what is left is counted anew
    return (state._replace(left=pending or 0) if state.left and pending else state), out


class Sweeper(StatefulProcessor):
    def __init__(self, interval: int, cap: int):
        self.interval, self.cap = interval, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("sweep", "stamp long, own boolean, left long")

    def _state(self) -> Debounced | None:
        return Debounced(*self.kept.get()) if self.kept.exists() else None

    def _keep(self, state: Debounced | None) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if state is None:
            self.kept.clear()
        else:
            self.kept.update(tuple(state))
            self.handle.registerTimer(state.stamp + self.interval)

    @staticmethod
    def _frame(key, sweeps: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *s) for s in sweeps], columns=[c.split()[0] for c in SWEEPS.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at_ms", "stamp_ms", "pending"], na_position="first")
        state, out = self._state(), []
        whole = lambda x: None if pd.isna(x) else int(x)
        for at, pending, stamp in zip(batch["at_ms"], batch["pending"], batch["stamp_ms"]):
            state, sweeps = stepped(state, int(at), whole(pending), whole(stamp), self.interval, self.cap)
            out += sweeps
        self._keep(state)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = drained(self._state(), expiredTimerInfo.getExpiryTimeInMs(), self.interval, self.cap)
        self._keep(state)
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def debounced_sweeps(rows: DataFrame, hours: float = 24, cap: int = 1000, late: str = "10 minutes") -> DataFrame:
    """``(project, at, archived, overflow, cause)``: the sweeps that a stream of activity gives.

    ``rows`` has project, at (timestamp), pending (how many candidates there are, null
    for a stamp) and stamp (timestamp of a sweep elsewhere, null for an activity). An
    activity within the interval of the last stamp gives no sweep. A stamp later than the
    row that brings it is ignored. ``cap`` below one means all. Rows of one project in a
    micro-batch go together, in the order of their times, so results don't depend on how
    rows in time order are cut into micro-batches; rows later than ``late`` are dropped,
    and a late one within it gives no sweep where a later one did. A null project is a
    project, a null time drops the row, and null counts are none. The session's state
    store must be RocksDB (``STORE``).
    """
    timed = rows.where("at is not null").withWatermark("at", late)
    of = timed.select(F.coalesce("project", F.lit("")).alias("project"), "at", F.unix_millis("at").alias("at_ms"), F.col("pending").cast("long").alias("pending"), F.unix_millis("stamp").alias("stamp_ms"))
    swept = of.groupBy("project").transformWithStateInPandas(Sweeper(int(hours * 3_600_000), cap), SWEEPS, "append", "eventTime")
    return swept.select("project", F.timestamp_millis("at_ms").alias("at"), "archived", "overflow", "cause")
