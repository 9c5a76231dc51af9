"""Bracketed units as a stream: one unit per closing event, or widened units that wait for their neighbour.

Events may come late and in any order within the watermark: they wait in the state until it passes them, and are then
paired in the order of time, so batches cut anywhere give the same units.  State per session: the events that wait, the
last opening and close, the times since that close within reach, and for widened units the unit that is held back.  A
session's state goes when the watermark is ``idle`` beyond its latest event.  The state store must be RocksDB
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PAIRING = "last_open bigint, prev_close bigint, first bigint, latest bigint, held_start bigint, held_end bigint, edge bigint"
_WAITING = "t bigint, opens boolean, closes boolean"
_UNIT = "session_id bigint, start_ts bigint, end_ts bigint, has_open boolean"
_WIDE = "session_id bigint, start_ts bigint, end_ts bigint, wide_start bigint, wide_end bigint"


class Pairer:
    """The bracket pairing of one session, event by event in the order of time."""

    def __init__(self, state: tuple | None, reach: list[int], max_unit: int, min_unit: int) -> None:
        self.max_unit, self.min_unit = max_unit, min_unit
        self.last_open, self.prev_close, self.first, self.latest, *self.held = state or (None,) * 7
        self.reach = deque(reach)  # times from the last close on, of which a unit may begin at the earliest

    def state(self) -> tuple:
        return self.last_open, self.prev_close, self.first, self.latest, *self.held

    def units(self, rows: list[tuple[int, bool, bool]]) -> Iterator[tuple[int, int, bool]]:
        pending: int | None = None  # an opening counts for later events only
        for t, is_open, is_close in rows:
            if pending is not None and pending < t:
                self.last_open, pending = pending, None
            self.first = t if self.first is None else self.first
            self.latest = t
            while self.reach and self.reach[0] < t - self.max_unit:
                self.reach.popleft()
            if not self.reach or self.reach[-1] < t:
                self.reach.append(t)
            if is_close:
                prev = self.first if self.prev_close is None else self.prev_close
                good = self.last_open is not None and self.last_open >= max(prev, t - self.max_unit)
                start = self.last_open if good else max(prev, self.reach[0])
                self.prev_close, self.reach = t, deque([t])
                if t - start >= self.min_unit:
                    yield start, t, good
            if is_open:
                pending = t
        if pending is not None:
            self.last_open = pending

    def widened(self, start: int | None, end: int | None, cap: int) -> tuple[int, int, int, int] | None:
        """The unit that was held, widened, as (start, end) comes; None, None ends the session."""
        held_start, held_end, edge = self.held
        out = None
        if held_start is not None:
            ahead = ((self.latest if start is None else start) - held_end) // 2
            back = (held_start - edge) // 2
            out = held_start, held_end, held_start - max(0, min(back, cap)), held_end + max(0, min(ahead, cap))
        self.held = [start, end, self.first if held_end is None else held_end] if start is not None else [None, None, None]
        return out


class Brackets(StatefulProcessor):
    """Pairs a session's events once the watermark has passed them; with ``cap``, widens the units."""

    def __init__(self, max_unit: int, min_unit: int, idle: int, cap: int | None = None) -> None:
        self.max_unit, self.min_unit, self.idle, self.cap = max_unit, min_unit, idle, cap
        self.names = [c.split()[0] for c in (_UNIT if cap is None else _WIDE).split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pairing = handle.getValueState("pairing", _PAIRING)
        self.reach = handle.getListState("reach", "t bigint")
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        frames = [f[["t", "event_type"]].dropna(subset=["t"]) for f in rows]
        new = [(int(t), kind == "view", kind == "purchase") for f in frames for t, kind in zip(f["t"], f["event_type"], strict=True) if not 0 < passed >= t]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(new)[0] // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in waiting if r[0] <= passed]
        if len(ready) < len(waiting):
            self.handle.registerTimer(-(-waiting[len(ready)][0] // 1000))
        known = self.pairing.get() if self.pairing.exists() else None
        if not ready and not known:
            return
        p = Pairer(tuple(known) if known else None, [r[0] for r in self.reach.get()] if self.reach.exists() else [], self.max_unit, self.min_unit)
        out, begin = [], 0
        for i, (t, _, _) in enumerate(ready):
            last = ready[i - 1][0] if i else p.latest
            if last is not None and t - last > self.idle:
                out += self.found(p, ready[begin:i], True)
                p, begin = Pairer(None, [], self.max_unit, self.min_unit), i
        rest = ready[begin:]
        latest = rest[-1][0] if rest else p.latest
        over = len(ready) == len(waiting) and passed >= latest + self.idle
        out += self.found(p, rest, over)
        if over:
            for state in (self.pairing, self.reach, self.waiting):
                state.clear()
        elif ready:
            self.pairing.update(p.state())
            self.reach.put([(t,) for t in p.reach])
            if len(ready) < len(waiting):
                self.waiting.put(waiting[len(ready) :])
            else:
                self.waiting.clear()
                self.handle.registerTimer(-(-(latest + self.idle) // 1000))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=self.names)

    def found(self, p: Pairer, rows: list[tuple[int, bool, bool]], over: bool) -> list[tuple]:
        units = p.units(rows)
        if self.cap is None:
            return list(units)
        wide = [p.widened(start, end, self.cap) for start, end, _ in units] + ([p.widened(None, None, self.cap)] if over else [])
        return [w for w in wide if w]

    def close(self) -> None:
        pass


def _run(events: DataFrame, processor: Brackets, schema: str, late: str) -> DataFrame:
    timed = events.select("session_id", "t", "event_type", "ts").withWatermark("ts", late)
    return timed.groupBy("session_id").transformWithStateInPandas(processor, schema, "append", "eventTime")


def bracket_stream(events: DataFrame, max_unit: int, min_unit: int, late: str = "0 seconds") -> DataFrame:
    """``session_id, start_ts, end_ts, has_open`` of ``events(session_id, t, event_type, ts)``, as the watermark passes closes.

    ``t`` is ``ts`` in microseconds; rows without one, and rows later than ``late``, are dropped.  State goes once a session
    has been idle for ``max_unit``: nothing older can matter to a unit, so a session that goes on later loses nothing.
    """
    return _run(events, Brackets(max_unit, min_unit, max_unit), _UNIT, late)


def expanded_stream(events: DataFrame, max_unit: int, min_unit: int, cap: int, idle: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """Widened units; each is emitted when the next one of its session closes, the last one when the session is over.

    A session is over when it has no event for longer than ``idle`` (``max_unit`` at least); what follows is a session of its
    own, wherever batches are cut.
    """
    wait = max(pd.Timedelta(idle) // pd.Timedelta("1us"), max_unit)
    return _run(events, Brackets(max_unit, min_unit, wait, cap), _WIDE, late)
