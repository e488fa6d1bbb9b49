"""Keyed state per identifier: days wait for a resolution, then for a summary, then go out.

Input events, one column set: ident, kind ('day', 'resolved', 'lease'), key, at, until.
Output rows: ident, key, outcome ('queued' when released, 'stale' when three days have passed
with no live lease).  An identifier has at most one entry per day, so its state is bounded by
the calendar.  A lease that has run out goes, whether or not its key was ever queued.

``hold_and_release`` keeps the identifiers of a hash bucket as one state row, read once and written
once for all events of a batch, with one timeout for whatever falls due first: a batch costs its
events, the state of the buckets it touches and one call a bucket.  Give it so many buckets that one
holds a few hundred identifiers.  ``hold_processor`` holds the same rules entry by entry, each found
by its key or its time; a call to the state store for every entry makes it the dearer one wherever
a batch brings more than a few events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "ident string, key string, outcome string, at timestamp"
#: A bucket's state, each part as arrays side by side: what resolved, is held, queued and leased.
PARTS = ("resolved", "held", "queued", "leased")
STATE = ", ".join(f"{p}_ident array<string>, {p}_key array<string>, {p}_ms array<long>"
                  for p in PARTS)
DAY_MS = 86_400_000
_COLUMNS = ["ident", "key", "outcome", "at"]


def hold_processor(stale_days: int) -> StatefulProcessor:
    """The processor, defined inside so workers receive it by value."""

    class HoldProcessor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.person = handle.getValueState("person", "resolved_ms long")
            self.held = handle.getMapState("held", "key string", "at_ms long")
            self.queued = handle.getMapState("queued", "key string", "due_ms long")
            self.leases = handle.getMapState("leases", "key string", "until_ms long")
            self.due = handle.getMapState("due", "at_ms long", "units array<string>")

        def _remind(self, at_ms: int, unit: str) -> None:
            units = self.due.getValue((at_ms,))[0] if self.due.containsKey((at_ms,)) else []
            if not units:
                self.handle.registerTimer(at_ms)
            if unit not in units:
                self.due.updateValue((at_ms,), ([*units, unit],))

        def _queue(self, ident: str, key: str, at_ms: int, out: list) -> None:
            if self.queued.containsKey((key,)):
                return
            due = at_ms + stale_days * DAY_MS
            self.queued.updateValue((key,), (due,))
            self._remind(due, key)
            out.append((ident, key, "queued", pd.Timestamp(at_ms, unit="ms")))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
            # A day goes out on the later of its own time and the resolution's, whichever comes
            # first, so the pieces of a batch are taken one by one, in any order.
            for piece in rows:
                yield self._take(key[0], piece.sort_values(["at", "rank", "key"]))

        def _take(self, ident: str, events: pd.DataFrame) -> pd.DataFrame:
            out = []
            for e in events.itertuples():
                at_ms = e.at.value // 1_000_000
                if e.kind == "resolved":
                    if not self.person.exists():
                        self.person.update((at_ms,))
                    for (held_key,), (held_ms,) in list(self.held.iterator()):
                        self._queue(ident, held_key, max(at_ms, held_ms), out)
                    self.held.clear()
                elif e.kind == "lease":
                    known = self.leases.getValue((e.key,)) if self.leases.containsKey((e.key,)) \
                        else (0,)
                    until = e.until.value // 1_000_000
                    if until > known[0]:
                        self.leases.updateValue((e.key,), (until,))
                        self._remind(until, e.key)
                elif self.person.exists():
                    self._queue(ident, e.key, max(at_ms, self.person.get()[0]), out)
                elif not self.held.containsKey((e.key,)):
                    self.held.updateValue((e.key,), (at_ms,))
            return pd.DataFrame(out, columns=_COLUMNS)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            # A lease that ended before the watermark blocks nothing any more, so what counts is
            # the watermark and not the (earlier) moment the timer was set for.
            now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
            moment, out = (expiredTimerInfo.getExpiryTimeInMs(),), []
            units = self.due.getValue(moment)[0] if self.due.containsKey(moment) else []
            self.due.removeKey(moment)
            for unit in units:
                until = self.leases.getValue((unit,))[0] if self.leases.containsKey((unit,)) else 0
                due = self.queued.getValue((unit,))[0] if self.queued.containsKey((unit,)) else None
                if due is not None and due <= now:
                    if until > now:  # leased: look again when the lease has run out
                        self.queued.updateValue((unit,), (until,))
                        self._remind(until, unit)
                        continue
                    self.queued.removeKey((unit,))
                    out.append((key[0], unit, "stale", pd.Timestamp(now, unit="ms")))
                if 0 < until <= now:  # it blocks nothing any more
                    self.leases.removeKey((unit,))
            yield pd.DataFrame(out, columns=_COLUMNS)

        def close(self) -> None:
            pass

    return HoldProcessor()


class Holds:
    """A bucket's state in plain dictionaries, and the rules on it."""

    def __init__(self, stale_ms: int, row: tuple | None = None) -> None:
        self.stale_ms, self.out = stale_ms, []
        parts = [dict(zip(zip(row[i], row[i + 1]), row[i + 2])) if row else {}
                 for i in range(0, 3 * len(PARTS), 3)]
        self.resolved = {ident: ms for (ident, _none), ms in parts[0].items()}
        self.held: dict[str, dict[str, int]] = {}
        for (ident, key), ms in parts[1].items():
            self.held.setdefault(ident, {})[key] = ms
        self.queued, self.leases = parts[2], parts[3]

    def row(self) -> tuple:
        resolved = {(ident, ""): ms for ident, ms in self.resolved.items()}
        held = {(ident, key): ms for ident, days in self.held.items() for key, ms in days.items()}
        return tuple(column for part in (resolved, held, self.queued, self.leases)
                     for column in ([ident for ident, _key in part], [key for _ident, key in part],
                                    list(part.values())))

    def _queue(self, ident: str, key: str, at_ms: int) -> None:
        if (ident, key) not in self.queued:
            self.queued[ident, key] = at_ms + self.stale_ms
            self.out.append((ident, key, "queued", at_ms))

    def take(self, events) -> None:
        """Events as (at, rank, key, ident, kind, until), in milliseconds."""
        for at_ms, _rank, key, ident, kind, until in sorted(events, key=lambda e: e[:2]):
            if kind == "resolved":
                self.resolved.setdefault(ident, at_ms)
                for held_key, held_ms in self.held.pop(ident, {}).items():
                    self._queue(ident, held_key, max(at_ms, held_ms))
            elif kind == "lease":
                if until > self.leases.get((ident, key), 0):
                    self.leases[ident, key] = until
            elif ident in self.resolved:
                self._queue(ident, key, max(at_ms, self.resolved[ident]))
            else:
                self.held.setdefault(ident, {}).setdefault(key, at_ms)

    def pass_time(self, now: int) -> None:
        """What is due by ``now`` goes out, or waits for its lease; leases that have ended go."""
        for unit, due in list(self.queued.items()):
            if due <= now:
                until = self.leases.get(unit, 0)
                if until > now:
                    self.queued[unit] = until
                else:
                    del self.queued[unit]
                    self.out.append((*unit, "stale", now))
        self.leases = {unit: until for unit, until in self.leases.items() if until > now}

    def next_ms(self) -> int | None:
        return min([*self.queued.values(), *self.leases.values()], default=None)


def _milliseconds(column: pd.Series) -> list[int]:
    return column.to_numpy().astype("datetime64[ms]").astype("int64").tolist()


def hold_step(stale_days: int):
    """The call for one bucket's events of a batch, or for its timeout."""

    def step(key, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holds = Holds(stale_days * DAY_MS, state.get if state.exists else None)
        # A day goes out on the later of its own time and the resolution's, whichever comes first,
        # so the pieces of a batch are taken one by one, in any order.
        for p in pieces:
            holds.take(zip(_milliseconds(p["at"]), p["rank"].tolist(), p["key"].tolist(),
                           p["ident"].tolist(), p["kind"].tolist(), _milliseconds(p["until"])))
        now = state.getCurrentWatermarkMs()
        holds.pass_time(now)
        state.update(holds.row())
        following = holds.next_ms()
        if following is not None:
            # A timeout fires when the watermark is past it, an entry is due when it is reached.
            state.setTimeoutTimestamp(max(following - 1, now, 1))
        if holds.out:
            out = pd.DataFrame(holds.out, columns=_COLUMNS)
            yield out.assign(at=pd.to_datetime(out["at"], unit="ms"))

    return step


def hold_and_release(events: DataFrame, stale_days: int = 3, delay: str = "0 seconds",
                     buckets: int = 4_096) -> DataFrame:
    """``events`` as a stream of outcomes; event time drives the staleness timers.

    ``buckets`` stays the same for the life of the stream, as its state is kept by them.
    """
    return (events.withWatermark("at", delay)
            .withColumn("bucket", F.pmod(F.xxhash64("ident"), F.lit(buckets))).groupBy("bucket")
            .applyInPandasWithState(hold_step(stale_days), OUTPUT, STATE, "append",
                                    GroupStateTimeout.EventTimeTimeout))
