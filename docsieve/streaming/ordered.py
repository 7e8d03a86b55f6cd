"""Guarded state machines over streams whose events come late and out of order, with state that timers bound."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from docsieve.operators.state import Moves, transition_moves

_COUNTS = ("accepted", "rejected", "retries")
_SETTLED = "state string, accepted long, rejected long, retries long"


def _step(moves: Moves, held: tuple, event: str) -> tuple:
    state, accepted, rejected, retries = held
    move = moves.get((state, event))
    return (move[0], accepted + 1, rejected, retries + bool(move[1])) if move else (state, accepted, rejected + 1, retries)


class OrderedReplay(StatefulProcessor):
    """Of each key a value state, what the events up to the watermark have come to, and a list state, the events behind
    it in whatever order they came.

    New events join the list; what is told is the value with the whole list folded on top, in order, so a late event
    takes its place among those told before. A timer at the time of a key's first waiting event moves what the watermark
    has passed from the list to the value: there is one for a key, not for each event, and the list holds the events of one delay, however long the stream runs. With a time to
    live, a key that nothing is heard of loses its state.
    """

    def __init__(self, key: str, start: str, moves: Moves, live_ms: int | None):
        self.key, self.start, self.moves, self.live_ms = key, start, moves, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", _SETTLED, ttlDurationMs=self.live_ms)
        self.waiting = handle.getListState("waiting", "at long, place long, event string", ttlDurationMs=self.live_ms)

    def _held(self) -> tuple:
        return tuple(self.settled.get()) if self.settled.exists() else (self.start, 0, 0, 0)

    def _waiting(self) -> list[tuple]:
        return [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []

    def _wake(self, micros: int) -> None:
        """A timer for the first event that waits; it moves all that the watermark has passed and sets the next one."""
        self.handle.registerTimer(micros // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [e for part in rows for e in zip(part["event_micros"].tolist(), part["event_place"].tolist(), part["event_name"].tolist(), strict=True)]
        waiting = self._waiting()
        self.waiting.appendList(new)
        first = min(new)[0]
        if not waiting or first < min(waiting)[0]:
            self._wake(first)
        told = reduce(lambda held, e: _step(self.moves, held, e[2]), sorted(waiting + new), self._held())
        yield pd.DataFrame({self.key: [key[0]], "state": [told[0]], **{c: [n] for c, n in zip(_COUNTS, told[1:], strict=True)}})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self._waiting())
        done = [e for e in waiting if e[0] // 1000 < passed]
        if done:
            self.settled.update(reduce(lambda held, e: _step(self.moves, held, e[2]), done, self._held()))
            rest = waiting[len(done) :]
            self.waiting.put(rest) if rest else self.waiting.clear()
            if rest:
                self._wake(rest[0][0])
        yield from ()

    def close(self) -> None:
        pass


#: Types of keys that a text gives back as they were.
_AS_TEXT = ("tinyint", "smallint", "int", "bigint", "string", "boolean", "date")


def group_step(start: str, moves: Moves) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What ``OrderedReplay`` does, for all keys of a group at once: the group's state has for each key what is settled
    and the events that wait, in order, and its one timer is for the first of them all.

    A processor asks for each part of each key's state on its own, and pandas is slow to begin; a group pays both once.
    A group that has events is not timed out, so it settles what the watermark has passed by itself.
    """

    def step(_: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(zlib.decompress(state.get[0])) if state.exists else {}
        fold = lambda x, es: reduce(lambda x, e: _step(moves, x, e[2]), es, x)
        if not state.hasTimedOut:
            new: dict[str, list] = {}
            for part in rows:
                for k, *e in zip(*(part[c].tolist() for c in ("event_key", "event_micros", "event_place", "event_name")), strict=True):
                    new.setdefault(k, []).append(tuple(e))
            for k, es in new.items():
                settled, waiting = held.get(k, ((start, 0, 0, 0), []))
                held[k] = settled, sorted(waiting + es)
            told = [(k, *fold(*held[k])) for k in new]
            yield pd.DataFrame(dict(zip(("event_key", "state", *_COUNTS), map(list, zip(*told, strict=True)), strict=True)))
        passed = state.getCurrentWatermarkMs()
        for k, (settled, waiting) in held.items():
            n = sum(e[0] // 1000 < passed for e in waiting)
            if n:
                held[k] = fold(settled, waiting[:n]), waiting[n:]
        state.update((zlib.compress(pickle.dumps(held), 1),))
        first = min((waiting[0][0] for _, waiting in held.values() if waiting), default=None)
        if first is not None:
            state.setTimeoutTimestamp(max(first // 1000 + 1, 1))

    return step


def replay_ordered(events: DataFrame, key: str, time: str, place: str, event: str, delay: str, start: str = "pending", moves: Moves | None = None, live_ms: int | None = None, groups: int = 256) -> DataFrame:
    """The streaming form of ``operators.state.fold`` for events that come out of order: (key, state, accepted,
    rejected, retries), the state each key is in after every micro-batch that has events of it. The last row of a key
    is what the batch form gives.

    ``time`` is the event time and ``place`` (a whole number) orders events of equal time. An event may come up to
    ``delay`` behind the latest seen; Spark drops what comes later still, so choose the delay by the source. Rows
    without an event or a time are left out. Keys go through Python in ``groups`` by hash, whose number must stay as it
    is while a stream lives (those with a time to live or of unusual types one by one, by ``OrderedReplay``). A task takes the
    events of one group and micro-batch; bound these by the source's ``maxFilesPerTrigger`` or the like. Write in update
    mode, on a session whose state store is RocksDB.
    """
    moves = transition_moves() if moves is None else moves
    kind = events.schema[key].dataType.simpleString()
    own = events.filter(F.col(event).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
    own = own.select(key, time, F.unix_micros(F.col(time).cast("timestamp")).alias("event_micros"), F.col(place).cast("long").alias("event_place"), F.col(event).alias("event_name"))
    if live_ms is not None or kind not in _AS_TEXT:
        return own.groupBy(key).transformWithStateInPandas(OrderedReplay(key, start, moves, live_ms), f"`{key}` {kind}, {_SETTLED}", "Update", "EventTime")
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # nothing else makes a null key whole again
    dealt = own.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("event_group"), name.alias("event_key"), time, "event_micros", "event_place", "event_name")
    told = dealt.groupBy("event_group").applyInPandasWithState(group_step(start, moves), f"event_key string, {_SETTLED}", "held binary", "update", GroupStateTimeout.EventTimeTimeout)
    own_key = F.when(F.col("event_key") != "", F.substr("event_key", F.lit(2))).cast(kind)
    return told.select(own_key.alias(key), "state", *_COUNTS)
