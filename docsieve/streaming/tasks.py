"""Streams of task events and comments, with state that outlives a restart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from docsieve.operators.state import Moves, transition_moves

_STATE = "state string, accepted long, rejected long, retries long"


def replay_stream(events: DataFrame, key: str, order: list[str], event: str, start: str = "pending", moves: Moves | None = None) -> DataFrame:
    """The streaming form of ``operators.state.fold``: per key its state and counts, each time they change.

    Events of a key are applied in order within a micro-batch and batch by batch between them, so a source must not
    deliver an event behind a later one of its key in an earlier batch. A task holds one key's events of one
    micro-batch at most; bound these by the source's ``maxFilesPerTrigger`` or the like. Write in update mode.
    """
    moves = transition_moves() if moves is None else moves
    kind = events.schema[key].dataType.simpleString()

    def apply(name: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, accepted, rejected, retries = held.get if held.exists else (start, 0, 0, 0)
        for e in pd.concat(list(batches)).sort_values(order, kind="stable")["_event"]:
            move = moves.get((state, e))
            accepted, rejected, retries = accepted + (move is not None), rejected + (move is None), retries + bool(move and move[1])
            state = move[0] if move else state
        held.update((state, accepted, rejected, retries))
        yield pd.DataFrame({key: [name[0]], "state": [state], "accepted": [accepted], "rejected": [rejected], "retries": [retries]})

    own = events.filter(F.col(event).isNotNull()).select(key, *order, F.col(event).alias("_event"))
    return own.groupBy(key).applyInPandasWithState(apply, f"`{key}` {kind}, {_STATE}", _STATE, "update", "NoTimeout")


def comments_once(attempts: DataFrame, at: str | None = None, within: str = "1 day") -> DataFrame:
    """The first attempt of each (instance_id, review_id) of a stream. With an event time, repeats are told for
    ``within`` and the state is bounded by it; without one they are told for ever."""
    keys = ["instance_id", "review_id"]
    return attempts.dropDuplicates(keys) if at is None else attempts.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)
