"""Streams whose rows come late, twice or in any order.

`in_order` holds the rows of a session until the watermark has passed their time, and hands them in order of `seq` to
a step, a plain function of the session's state. A row that comes when the watermark has passed it, or
whose number is no larger than one that was handed on, is not folded in: the step's `late` makes it a row of a side output.
A number that is held already is dropped. State is what the watermark's delay leaves to wait for, and one value for each
session, which goes after `idle_ms` without rows."""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Step:
    """What is done with a session's rows in order. state: a DDL of the session's value; start: its first one; run: gives
    the next value and rows for (value, key, rows in order); late: the row told of one that came too late; out: a DDL of the
    rows given; columns: a DDL of what a row has beside session, seq and ts_ms, with names of Python's kind."""

    state: str
    start: tuple
    run: Callable[[tuple, str, list[tuple]], tuple[tuple, list[Row]]]
    late: Callable[[str, tuple], Row]
    out: str
    columns: str = field(default="kind STRING, text STRING")

    @property
    def names(self) -> tuple[str, ...]:
        return ("seq", "ts_ms", *[c.split()[0] for c in self.columns.split(", ")])


@cache
def maker(names: Sequence[str]) -> Callable[[Iterable], tuple]:
    """Makes a row of its fields: a named tuple, whose fields are read many times faster than a Row's."""
    return namedtuple("Named", names)._make


def named(rows: Iterable[Row], names: Sequence[str]) -> Iterator[tuple]:
    """The columns `names`, two at least, of each row as named tuples."""
    make, pick = maker(names), None
    for r in rows:
        pick = pick or itemgetter(*map(r.__fields__.index, names))
        yield make(pick(tuple(r)))


class InOrder(StatefulProcessor):
    """State: for each session one value, the step's with the last number handed on, the latest time seen and the rows that
    wait, packed into one field. Every call of the state is a message between processes, and every row of a list has one's
    cost, so a session is read and written once in a batch, however many rows wait. It has one timer at most: for the
    earliest row that waits or, if none does, for the end of its idle time. A session that gets rows hands on
    those that are due at once, so only the others' timers have something to do."""

    def __init__(self, step: Step, idle_ms: int | None = None):
        self.step, self.idle_ms = step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.names = handle, self.step.names
        self.value = handle.getValueState("value", f"{self.step.state}, _last BIGINT, _seen BIGINT, _waiting BINARY")

    def _now(self) -> tuple[tuple, int | None, int, list[tuple]] | None:
        if not self.value.exists():
            return None
        *value, last, seen, waiting = self.value.get()
        return tuple(value), last, seen, pickle.loads(waiting) if waiting else []

    def _due(self, held: list[tuple], seen: int) -> int | None:
        if held:
            return min(r[1] for r in held)
        return None if self.idle_ms is None else seen + self.idle_ms

    def _hand_on(self, key: tuple, value: tuple, last: int | None, held: list[tuple], passed: int) -> tuple[tuple, int | None, list[tuple], list[Row]]:
        """The value, the last number and the rows that go on waiting after those that the watermark has passed, and rows out."""
        ready, out, fit = sorted(r for r in held if r[1] <= passed), [], []
        if not ready:
            return value, last, held, out
        for r in map(maker(self.names), ready):
            if last is not None and r.seq <= last:  # its time is after that of a larger number
                out.append(self.step.late(key[0], r))
            else:
                fit.append(r)
                last = r.seq
        value, told = self.step.run(value, key[0], fit)
        return value, last, [r for r in held if r[1] > passed], out + told

    def _keep(self, value: tuple, last: int | None, seen: int, held: list[tuple], passed: int, before: int | None) -> None:
        """Writes the session and moves its timer, which stood at `before`."""
        due = self._due(held, seen)
        if due is not None and due <= passed:  # nothing waits, and the idle time is over
            self.value.clear()
            due = None
        else:
            self.value.update((*value, last, seen, pickle.dumps(held) if held else None))
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        passed, found = timerValues.getCurrentWatermarkInMs(), self._now()
        value, last, seen, held = found or (self.step.start, None, 0, [])
        before = self._due(held, seen) if found else None
        here, out, n = {r[0] for r in held}, [], len(held)
        for r in named(rows, self.names):
            if r.ts_ms <= passed or (last is not None and r.seq <= last):
                out.append(self.step.late(key[0], r))
            elif r.seq not in here:
                here.add(r.seq)
                held.append(tuple(r))
                seen = max(seen, r.ts_ms)
        changed = len(held) > n
        value, last, rest, told = self._hand_on(key, value, last, held, passed)
        if changed or len(rest) < len(held):
            self._keep(value, last, seen, rest, passed, before)
        yield from out
        yield from told

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        passed, found = timerValues.getCurrentWatermarkInMs(), self._now()
        if found is None:
            return
        value, last, seen, held = found
        due, fired = self._due(held, seen), expiredTimerInfo.getExpiryTimeInMs()
        if due is None or due > passed:
            return
        value, last, rest, told = self._hand_on(key, value, last, held, passed)
        self._keep(value, last, seen, rest, passed, None if due == fired else due)  # one that has fired goes by itself
        yield from told

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, step: Step, delay: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """What `step` gives for the streamed `rows` (session, seq, ts_ms and the step's columns), each session's in order of seq.
    delay: how far behind the latest time seen a row may come. Rows without session, seq or ts_ms have no place and are
    dropped. The session's store must be RocksDB: see `fold.PROVIDER`."""
    whole = rows.where("session is not null and seq is not null and ts_ms is not null")
    timed = whole.withColumn("_at", F.timestamp_millis("ts_ms")).withWatermark("_at", delay)
    return _grouped(timed, step, idle_ms)


def _grouped(timed: DataFrame, step: Step, idle_ms: int | None) -> DataFrame:
    # Without the column of the watermark: rows that come too late must reach the processor, which tells of them.
    return timed.select("session", *step.names).groupBy("session").transformWithState(InOrder(step, idle_ms), step.out, "Append", "EventTime")


def in_order_all(streams: Sequence[DataFrame], step: Step, delay: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """The same for several streams of the same columns as one. Each has a watermark of its own; the slowest counts."""
    timed = [s.where("session is not null and seq is not null and ts_ms is not null").withColumn("_at", F.timestamp_millis("ts_ms")).withWatermark("_at", delay) for s in streams]
    both = timed[0]
    for other in timed[1:]:
        both = both.unionByName(other)
    return _grouped(both, step, idle_ms)


def once(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streamed `rows` (session, seq, ts_ms, ...) without those that come again within the delay, by session and seq. State
    is one number for each row until the watermark has passed it."""
    timed = rows.withColumn("_at", F.timestamp_millis("ts_ms")).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark(["session", "seq"]).drop("_at")
